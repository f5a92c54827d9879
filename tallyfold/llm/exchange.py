"""Asking a table partitioned by key about the keys of every chunk of documents.

Documents are grouped into chunks of neighbouring ids. A chunk sends each of its distinct 64-bit keys
once, sorted and packed, to the part of the key range that owns it; the part answers with one number
or bit per key, in the same order, so that neither keys nor document ids travel back. However common
a key is, a chunk sends it once, so no key makes a part hot; parts are cut by counted keys.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import kind, tidied

#: Bytes of text in a chunk, on average, and keys in a part: what a task holds at a time.
CHUNK_BYTES, PART_KEYS = 6_000_000, 2_000_000
#: Bytes of text hashed at a time.
SLICE_BYTES = 500_000
#: Odd multipliers of the polynomial hashes, and their inverses modulo 2^64.
OF_BYTES, OF_WORDS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
INVERSES = pow(OF_BYTES, -1, 1 << 64), pow(OF_WORDS, -1, 1 << 64)
#: Another multiplier of words, for a second hash.
AGAIN = 0xD6E8FEB86659FD93


def in_chunks(docs: DataFrame, carried: list, chunk_bytes: int = None) -> tuple[DataFrame, int]:
    """(doc_id, text, carried, chunk) with chunks in the order of doc_id, null ids first; and the bytes of text.

    carried: a structure of the named columns, which comes back with the answers; of the text it
    only tells whether it is null. Texts are compressed while they travel.
    """
    marked = [F.when(F.col(c).isNotNull(), F.lit("")).alias(c) if c == "text" else F.col(c) for c in carried]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*marked).alias("carried"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (chunk_bytes or CHUNK_BYTES)))
    shares = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("c")).first().c if shares else None
    bounds = np.unique(np.array(found or [], np.int64))

    @F.arrow_udf("long")
    def chunk_of(ids: pa.Array) -> pa.Array:
        known = np.searchsorted(bounds, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "left")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, known))

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.array([pack(text.as_buffer()) for text in texts], pa.binary())

    return docs.withColumn("chunk", chunk_of(F.col("doc_id").cast("long"))).withColumn("text", packed("text")), total


def powers(base: int, size: int) -> np.ndarray:
    """base to the power 0, 1, ... modulo 2^64."""
    found = np.full(size, base, np.uint64)
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64)


#: Kept for slices of usual size only, whatever the longest text.
_kept_powers = functools.lru_cache(2)(powers)


def _byte_powers(base: int, size: int) -> np.ndarray:
    usual = 2 * SLICE_BYTES
    return _kept_powers(base, usual)[:size] if size <= usual else powers(base, size)


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_words(words: list) -> np.ndarray:
    joined = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_byte_values()[joined] * _byte_powers(OF_BYTES, len(joined)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _byte_powers(INVERSES[0], len(joined) + 1)[starts] + lengths.astype(np.uint64))


def word_hashes(texts: list, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after the other, and the number of words of each text.

    Words are separated by blanks and control white space of ASCII; lower: A to Z are lower-cased.
    """
    hashes, counts, held, size = [np.zeros(0, np.uint64)], [], [], 0
    for text in texts:
        data = text.encode("utf-8", "replace")
        words = (data.lower() if lower else data).split()
        counts.append(len(words))
        held += words
        size += len(data)
        if size > SLICE_BYTES:
            hashes.append(_hash_words(held))
            held, size = [], 0
    if held:
        hashes.append(_hash_words(held))
    return np.concatenate(hashes), np.array(counts, np.int64)


class Sequences:
    """Hashes of runs of words, from prefix sums."""

    def __init__(self, words: np.ndarray, base: int = OF_WORDS):
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * powers(base, self.n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), self.n + 1)

    def of(self, first: int, last: int, starts: int) -> np.ndarray:
        """For each position p < starts, the hash of words p + first to p + last - 1."""
        found = self.sums[last:last + starts] - self.sums[first:first + starts]
        found *= self.back[first:first + starts]
        return mixed(found + np.uint64(last - first))


def squeezed(values: np.ndarray) -> bytes:
    """Non-negative numbers as planes of bytes, without the high bytes that none of them needs."""
    values = values.astype("<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    width = memoryview(data)[0]
    found = zstandard.ZstdDecompressor().decompress(memoryview(data)[1:])
    planes[:, :width] = np.frombuffer(found, np.uint8).reshape(width, n).T
    return planes.view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueezed(data, n), dtype=np.uint64)


def even_cuts(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def ask(chunks: DataFrame, keys_of, cuts: np.ndarray, answer) -> DataFrame:
    """(chunk, part, answers): what the parts answer to the chunks.

    keys_of(texts) gives a chunk's sorted distinct keys and their counts (None: not sent). answer(keys,
    counts, source, order) gets all keys of a part, sorted, with ties in the order of chunks, and gives
    (values, bits): one number for each, in that order, sent back as bits or as numbers.
    """

    def send(chunk: pa.Table) -> pa.Table:
        chunk = ordered(chunk)
        keys, counts = keys_of(chunk["text"].to_pylist())
        ends = [0, *np.searchsorted(keys, cuts, "left").tolist(), len(keys)]
        full = [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        return pa.table({
            "chunk": pa.array([chunk["chunk"][0].as_py()] * len(full), pa.int64()),
            "part": pa.array([k for k, _, _ in full], pa.int64()),
            "n": pa.array([b - a for _, a, b in full], pa.int64()),
            "keys": pa.array([packed_keys(keys[a:b]) for _, a, b in full], pa.binary()),
            "counts": pa.array([None if counts is None else squeezed(counts[a:b]) for _, a, b in full], pa.binary())})

    def reply(part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        sizes = part["n"].to_pylist()
        keys = np.concatenate([unpacked_keys(k.as_buffer(), n) for k, n in zip(part["keys"], sizes, strict=True)])
        counts = None
        if part["counts"].null_count == 0:
            counts = np.concatenate([unsqueezed(k.as_buffer(), n) for k, n in zip(part["counts"], sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        found, bits = answer(keys[order], None if counts is None else counts[order])
        values = np.empty(len(keys), found.dtype)
        values[order] = found
        ends = np.cumsum([0, *sizes])
        pack = (lambda x: np.packbits(x).tobytes()) if bits else squeezed
        return pa.table({
            "chunk": part["chunk"], "part": part["part"], "n": part["n"],
            "answers": pa.array([pack(values[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())})

    # All columns go along, so that with_answers() reads the same shuffled chunks again.
    sent = chunks.groupBy("chunk").applyInArrow(
        lambda chunk: tidied(send, chunk), "chunk long, part long, n long, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(
        lambda part: tidied(reply, part), "chunk long, part long, n long, answers binary")


def ordered(chunk: pa.Table) -> pa.Table:
    """A chunk's documents, unpacked, by id, null first, then by text."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = pa.array([unpack(text.as_buffer()) for text in chunk["text"]], pa.binary()).cast(pa.string())
    chunk = chunk.set_column(chunk.schema.get_field_index("text"), "text", texts)
    return chunk.take(pc.sort_indices(chunk, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def with_answers(chunks: DataFrame, answers: DataFrame, apply, columns: str, bits: bool) -> DataFrame:
    """Brings the answers back to the chunks: apply(texts, values) gives the columns named besides those carried."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        chunk, replies = ordered(chunk), replies.sort_by("part")
        sizes, found = replies["n"].to_pylist(), replies["answers"].to_pylist()
        if bits:
            values = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(found, sizes, strict=True)]
        else:
            values = [unsqueezed(x, n) for x, n in zip(found, sizes, strict=True)]
        made = apply(chunk["text"].to_pylist(), np.concatenate(values) if values else np.zeros(0, np.uint64))
        return pa.table([chunk["carried"], *made], names=["carried", *names])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda chunk, replies: tidied(run, chunk, replies), f"carried {kind(chunks, 'carried')}, {columns}")
