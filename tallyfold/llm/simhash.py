"""SimHash near-duplicates, with candidates filtered by chains of segments on a ring.

A fingerprint's 64 bits form a ring of 16 segments of 4. If two fingerprints differ in at most 3
bits, the differences cannot exceed their proportional share everywhere: from some segment on, every
chain of k consecutive segments holds at most 3k/16 of them. So the first 5 segments of the chain
are equal, and of the next 5 at most one bit differs: then the first 2 or the last 3 of these are
equal as well. Either makes a join key of 28 or 32 bits, 32 keys a fingerprint, in place of short
blocks with crowded buckets. Candidates that share a key must pass the whole chain's budget before
all 64 bits are compared.

Equal fingerprints are one entry. A key's entries are split into blocks, blocks are paired, and a
task gives the links that span what is connected in its pair of blocks, never all pairs.

Cases: a null or empty text has no words and fingerprint zero; fewer words than the shingle's width
are one shingle; repeated shingles count each time; texts are read whole; repeated rows keep a row
each; a document without an id has a fingerprint, but gives its component no name (null, if no
other does); other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import components, cut, kind, local_components, paired_blocks, whole_runs

SEED = 42
BITS, SEGMENTS, DISTANCE = 64, 16, 3
SEGMENT_BITS = BITS // SEGMENTS
#: Fingerprints in a block; a task compares two blocks at a time.
BLOCK = 1024
#: Shingles of a text that are hashed at a time.
PIECE = 1 << 15


def shingle_hashes(text: str, width: int):
    """XXH64 of every shingle of lower-cased words, in pieces of the text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        yield np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    ends = ends[width - 1:]
    del words
    for at in range(0, len(ends), PIECE):
        places = zip(starts[at:at + PIECE].tolist(), ends[at:at + PIECE].tolist())
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in places], np.uint64)


def fingerprint(text: str, width: int) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text or "", width):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n, ones = n + len(hashes), ones + bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint long for every row of docs."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(text.as_py(), width) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, fingerprint long")


def chain_keys(fingerprint: str = "fingerprint"):
    """An array of the join keys: chain start and form in the high bits, equal segments below."""
    keys, value = [], F.col(fingerprint)
    for start in range(SEGMENTS):
        by = SEGMENT_BITS * start
        turned = value if not by else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, BITS - by))
        first = F.shiftrightunsigned(turned, BITS - 20)
        near = F.shiftrightunsigned(turned, BITS - 28)
        far = F.shiftleft(first, 12).bitwiseOR(F.shiftrightunsigned(turned, BITS - 40).bitwiseAND(F.lit(0xFFF)))
        keys += [near.bitwiseOR(F.lit(2 * start << 40)), far.bitwiseOR(F.lit(2 * start + 1 << 40))]
    return F.array(*keys)


def _within_budget(apart: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Does the chain from `start` hold at most 3k/16 differing bits in every k segments?"""
    by = (SEGMENT_BITS * start).astype(np.uint64)
    turned = np.where(by > 0, apart << by | apart >> (np.uint64(BITS) - by) % np.uint64(BITS), apart)
    fine = np.ones(len(apart), bool)
    for k in range(1, SEGMENTS + 1):
        fine &= np.bitwise_count(turned >> np.uint64(BITS - SEGMENT_BITS * k)) <= k * DISTANCE // SEGMENTS
    return fine


def _links(key: np.ndarray, run_of: np.ndarray, side: np.ndarray, crossing: np.ndarray, value: np.ndarray):
    """Positions of linked entries of the same run."""
    start = key >> 41
    at, step, a, b = np.arange(len(value)), 0, [], []
    while len(at):
        step += 1
        at = at[at + step < len(value)]
        at = at[run_of[at] == run_of[at + step]]
        other = at + step
        apart = (value[at] ^ value[other]).view(np.uint64)
        good = ~crossing[at] | (side[at] != side[other])
        good &= _within_budget(apart, start[at]) & (np.bitwise_count(apart) <= DISTANCE)
        a.append(at[good])
        b.append(other[good])
    return (np.concatenate(a), np.concatenate(b)) if a else (at, at)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most DISTANCE bits apart, as many as connect them."""
    keyed = distinct.select("fingerprint", F.explode(chain_keys()).alias("key"))
    spread = paired_blocks(keyed, "key", "fingerprint", BLOCK)
    order = ["key", "block_a", "block_b"]
    sorted_ = spread.repartition(*map(F.col, order)).sortWithinPartitions(*order)

    def run(batches):
        for batch in whole_runs(batches, order):
            key, a, b, side, value = (batch[n].to_numpy() for n in ("key", "block_a", "block_b", "side", "fingerprint"))
            new = (np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
            run_of = np.append(0, np.cumsum(new))
            left, right = _links(key, run_of, side, a != b, value)
            label = local_components(len(value), left, right)
            at = np.flatnonzero(label != np.arange(len(value)))
            found = np.unique(np.stack([value[at], value[label[at]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return sorted_.select(*order, "side", "fingerprint").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint long, component_id (smallest doc_id reachable) for every row of docs."""
    marked = cut(fingerprints(docs, width))
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fingerprint")))
    named = distinct.join(found, distinct.fingerprint == found.node, "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(names, "component").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
