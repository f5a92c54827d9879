"""Best-fit packing of token pieces into sequences of a fixed length.

Pieces of one length are interchangeable, so best fit decreasing is decided on the table of lengths
(at most `capacity` rows, whatever the number of documents): a segment tree over remaining capacities
finds the tightest open bins that still take a length, all bins alike are filled in one step, and
each step becomes a run "pieces k to l of this length go to bins from b on, q in each, at offset o".
Spark numbers the pieces of each length in parts and joins them with the runs.

Cases: null counts as an empty text, which is one piece with only the end id; longer documents than
the capacity are cut, the first piece takes what is left over; ties and repeated rows are pieces of
their own; an empty table packs to nothing; other columns are not read.
"""

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import cut, kind, numbered

#: Texts of these characters are split alike by both libraries; others go to the tokenizer itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*")
#: Fixed value: the pretoken pattern of the byte-level vocabulary.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES_PER_PART = 20_000


def _byte_of() -> dict:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(byte): byte for byte in shown} | {chr(256 + k): byte for k, byte in enumerate(hidden)}


class Ids:
    """Ids of texts as little-endian bytes.

    The tokenizer's vocabulary and merges, as ranks, are run by a faster library where the texts
    cannot differ in how they are split: no special tokens, only plain characters. Both must agree
    on a probe.
    """

    PROBE = "It's  a probe:\n\n\tvaléur 12,34 (x_y)==  don't §½ñ \r\n  end "

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [token.content for token in added.values()]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): k for token, k in self.tokenizer.get_vocab(False).items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        if self.of(self.PROBE) != self.encoded(self.PROBE):
            raise ValueError("the tokenizer is not of the byte-level kind that these ranks describe")

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(token in text for token in self.special):
            return self.encoded(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:
            # It splits with a stack that runs of about a million blanks or line ends exceed.
            return self.encoded(text)


@functools.lru_cache(1)
def _ids(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, on demand) of every document's pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = _ids(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for at, text in enumerate(batch["text"]):
                data = memoryview(ids_of.of(text.as_py() or "") + end)
                n = len(data) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(at)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a:4 * b]))
                    if with_ids:
                        ids.append(np.frombuffer(data[4 * a:4 * b], "<u4").astype(np.int32))
            columns = [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """Bins by remaining capacity, with a segment tree that finds the tightest one in log time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)
        self.groups = [[] for _ in range(self.leaves)]

    def add(self, room: int, first: int, count: int) -> None:
        self.groups[room].append((first, count))
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = True
            node //= 2

    def take(self, room: int) -> tuple:
        group = self.groups[room].pop()
        if not self.groups[room]:
            node = room + self.leaves
            self.any[node] = False
            while node > 1 and not (self.any[node] or self.any[node ^ 1]):
                node //= 2
                self.any[node] = False
        return group

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity >= least that has a bin; -1 if there is none."""
        node = least + self.leaves
        if self.any[node]:
            return least
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.any[2 * node])
                return node - self.leaves
            node //= 2
        return -1


def best_fit_runs(counts: dict, capacity: int) -> list:
    """Best fit decreasing for counts[length] pieces: (length, first piece, pieces, first bin, each, offset).

    Piece first + i goes to bin first_bin + i // each, at offset + (i % each) * length.
    """
    bins, made, runs = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                count = -(-left // each)
                first, made = made, made + count
            else:
                first, count = bins.take(room)
                each = room // length
            used = min(count, -(-left // each))
            if used < count:
                bins.add(room, first + used, count - used)
            placed = min(left, used * each)
            runs.append((length, at, placed, first, each, capacity - room))
            full, rest = divmod(placed, each)
            if full and room - each * length:
                bins.add(room - each * length, first, full)
            if rest:
                bins.add(room - rest * length, first + full, 1)
            at, left = at + placed, left - placed
    return runs


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity; doc_id and piece break ties.

    `found` is read twice: give it cut off from costly work.
    """
    spark = found.sparkSession
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(
        best_fit_runs(counts, capacity),
        "length long, first long, placed long, first_bin long, each long, base long")
    parts = max(1, sum(counts.values()) // PIECES_PER_PART)
    ranked = numbered(found, ["length"], ["doc_id", "piece", "ids_crc32"], parts, "_rank")
    step = F.col("_rank") - F.col("first")
    placed = ranked.join(runs, "length").where(step.between(F.lit(0), F.col("placed") - 1))
    return placed.select(
        *found.columns, (F.col("first_bin") + F.floor(step / F.col("each"))).alias("sequence_id"),
        (F.col("base") + step % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path, capacity)), capacity)
