"""Repeated passages, found in prefix-partitioned suffix trees.

Every word of a text begins a suffix. A suffix's key lists hashes of its first words at growing depth
(a tenth, a quarter and all of the window), the shallow ones in the high bits: keys that agree
in their leading bits are suffixes with a common prefix, and sorted keys are the leaves of the suffix
tree in order, cut at the depth of the window, below which nothing is asked. One pass counts short
prefixes; a prefix with more suffixes than a task may hold is extended by further bits, light
neighbours are joined, so that each group fits in memory. Within a group's subtree the nodes at full
depth with more than one leaf are repeats of at least the window's length; all leaves but the first,
in the order of documents and places, are marked. Documents join marked windows into maximal spans.

Within a chunk of documents equal suffixes are one leaf, so frequent passages do not crowd a group.
Equality is that of 48 bits of the key and 32 of a second hash beside it, all of which cover the whole
window; so windows that share a prefix are told apart by 80 bits, and crowded prefixes are cut by 48.

Cases: a null text has no words; a text shorter than the window keeps all; a null id comes before all
others, rows of the same id are ordered by text; repeated rows repeat their text and lose it; texts
are read whole; other columns are not read.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import exchange

#: Bits of the short prefixes that are counted, and bits of the second hash.
COUNTED, SECOND = 16, 32


def suffix_keys(sequences: exchange.Sequences, window: int) -> np.ndarray:
    """The key of each position from which a whole window of words follows."""
    starts = max(0, sequences.n - window + 1)
    depths = [0, max(1, window // 10), max(1, window // 4)]
    keys = np.zeros(starts, np.uint64)
    for first, last in zip(depths, depths[1:]):
        keys = keys << np.uint64(8) | sequences.of(min(first, last - 1), last, starts) >> np.uint64(56)
    return keys << np.uint64(48) | sequences.of(0, window, starts) >> np.uint64(16)


def second_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Of each window `SECOND` bits of a hash of its own."""
    starts = max(0, len(words) - window + 1)
    return exchange.Sequences(words, exchange.AGAIN).of(0, window, starts) >> np.uint64(64 - SECOND)


def distinct(keys: np.ndarray, second: np.ndarray):
    """The order of (key, second), ties by place, and where in it another pair begins."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if (same & (second[order[1:]] != second[order[:-1]])).any():
        order = np.lexsort((second, keys))
        same = (keys[order[1:]] == keys[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    return order, np.append(True, ~same)[:len(keys)]


def _keys(texts: list, window: int):
    """Keys of all windows, whether each lies within a document, the documents' word counts, and all words' hashes."""
    words, counts = exchange.word_hashes(texts, lower=False)
    keys = suffix_keys(exchange.Sequences(words), window)
    within = np.ones(len(keys), bool)
    for end in np.cumsum(counts)[:-1]:
        within[max(0, end - window + 1):end] = False
    return keys, within, counts, words


def prefix_cuts(docs: DataFrame, window: int) -> np.ndarray:
    """Where the key range is cut: groups of prefixes, longer where suffixes are many."""

    def count(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                texts = [x or "" for x in batch["text"].slice(start, 1000).to_pylist()]
                keys, within, _, _ = _keys(texts, window)
                prefix, n = np.unique(keys[within] >> np.uint64(64 - COUNTED), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prefix.astype(np.int64)), pa.array(n)], ["prefix", "n"])

    counted = docs.select("text").mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    cuts, held, width = [], 0, 64 - COUNTED
    for prefix, n in sorted(map(tuple, counted.collect())):
        if held + n > exchange.PART_KEYS and held:
            cuts.append(prefix << width)
            held = 0
        pieces = -(-n // exchange.PART_KEYS)
        cuts += [(prefix << width) + (k << width) // pieces for k in range(1, pieces)]
        held = held + n if pieces == 1 else exchange.PART_KEYS
    return np.array(cuts, np.uint64)


def spans(marked: np.ndarray) -> list:
    """(start, end) of the runs of marked words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def remove_repeats(docs: DataFrame, window: int = 20, carried=("doc_id",), keep_untouched: bool = False) -> DataFrame:
    """carried, n_words, n_removed, spans (of removed words), kept_text for every row of docs.

    A word goes if a window of `window` words covers it whose words also start earlier: in a document
    of smaller id, or before it in the same one. Kept words are joined by one blank; keep_untouched
    leaves texts as they are that lose nothing. carried is a structure of the named columns.
    """
    chunks, _ = exchange.in_chunks(docs, list(carried))

    def keys_of(texts):
        keys, within, _, words = _keys(texts, window)
        keys, second = keys[within], second_hashes(words, window)[within]
        order, new = distinct(keys, second)
        return keys[order[new]], second[order[new]]

    def repeated(keys, second):
        order, new = distinct(keys, second)
        found = np.empty(len(keys), bool)
        found[order] = ~new
        return found, True

    def apply(texts, earlier):
        keys, within, counts, words = _keys(texts, window)
        at = np.flatnonzero(within)
        order, new = distinct(keys[at], second_hashes(words, window)[at])
        marked = np.empty(len(at), bool)
        marked[order] = earlier[np.cumsum(new) - 1].astype(bool) | ~new
        change = np.zeros(counts.sum() + 1, np.int64)
        np.add.at(change, at[marked], 1)
        np.add.at(change, at[marked] + window, -1)
        covered = np.cumsum(change)[:-1] > 0
        ends = np.cumsum(counts)
        removed, where, kept = [], [], []
        for text, a, b in zip(texts, (ends - counts).tolist(), ends.tolist(), strict=True):
            own, data = covered[a:b], text.encode("utf-8", "replace")
            removed.append(int(own.sum()))
            where.append(spans(own) if removed[-1] else [])
            if removed[-1]:
                kept.append(b" ".join(itertools.compress(data.split(), ~own)))
            else:
                kept.append(data if keep_untouched else b" ".join(data.split()))
        return [pa.array(counts), pa.array(removed, pa.int64()),
                pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()).cast(pa.string())]

    answers = exchange.ask(chunks, keys_of, prefix_cuts(docs, window), repeated)
    return exchange.with_answers(
        chunks, answers, apply,
        "n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept_text string", bits=True)
