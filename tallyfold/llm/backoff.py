"""Stupid-backoff scores of all documents by the n-gram counts of all documents.

Counts of 1- to n-grams lie in a table partitioned by the n-gram's hash; n-grams of two words and more
that occur fewer than `least` times are not in it. Every document's n-grams are joined with the table,
and the score of a word is the count of the longest n-gram that ends with it and is in the table, over
the count of the same without its last word, times 0.4 for each word by which the n-gram was cut:

    S(w | context) = c(context w) / c(context), or 0.4 S(w | context without its first word)

down to c(w) / number of words. A document's score is the sum of log10 S, in millionths, each rounded.

Cases: a null or empty text has no words and score 0; words are lower-cased (A to Z) and end at ASCII
white space; texts are read whole; repeated rows count and are scored each; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfold.llm import exchange

ALPHA = 0.4
#: The key of the n-gram without words, whose count is the number of words.
EMPTY = exchange.mixed(np.ones(1, np.uint64))
#: Bytes of a word with its blank, about: only sets how many parts the table has.
WORD_BYTES = 6


def _grams(texts: list, order: int):
    """Keys of the n-grams: the empty one, then those of 1 to order words; which places have one of
    each length; the texts' word counts; each word's place in its text."""
    words, counts = exchange.word_hashes(texts, lower=True)
    sequences = exchange.Sequences(words)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    #: The n-gram that begins at p is within a document if the word at p + k - 1 is at least its k-th.
    within = [place[k - 1:] >= k - 1 for k in range(1, order + 1)]
    keys = [EMPTY[:min(1, len(words))]]
    for k, inside in enumerate(within, 1):
        keys.append(sequences.of(0, k, max(0, len(words) - k + 1))[inside] + np.uint64(k))
    return np.concatenate(keys), within, counts, place


def score(docs: DataFrame, order: int = 3, least: int = 2) -> DataFrame:
    """doc_id, n_words, n_by_order (words scored by 1-grams, 2-grams, ...), score_micro for every row."""
    # Larger chunks send fewer keys twice.
    chunks, total = exchange.in_chunks(docs, ["doc_id"], exchange.CHUNK_BYTES * 3 // 2)
    parts = max(1, total // WORD_BYTES * order // exchange.PART_KEYS)

    def keys_of(texts):
        keys, _, counts, _ = _grams(texts, order)
        found, n = np.unique(keys, return_counts=True)
        n[found == EMPTY[0]] = counts.sum()
        return found, n

    def totals(keys, counts):
        new = np.append(True, keys[1:] != keys[:-1])
        return np.add.reduceat(counts, np.flatnonzero(new))[np.cumsum(new) - 1], False

    def apply(texts, values):
        keys, within, counts, place = _grams(texts, order)
        n = len(place)
        keys = np.unique(keys, return_inverse=True)[1]
        of = np.split(values[keys].astype(np.float64), np.cumsum([len(keys) and 1, *(w.sum() for w in within)])[:-1])
        ending = []  # count of the k-gram that ends at each word, 0 where there is none
        for k in range(1, order + 1):
            one = np.zeros(n)
            one[k - 1:][within[k - 1]] = of[k]
            ending.append(one)
        used, found = np.ones(n, np.int64), np.log10(ALPHA ** (order - 1) * ending[0] / (of[0][0] if n else 1))
        # Words at the beginning have fewer words before them and start from a shorter n-gram.
        longest = np.minimum(place + 1, order)
        for k in range(1, order + 1):
            context = np.append(0, ending[k - 2])[:n] if k > 1 else np.full(n, of[0][0] if n else 1)
            good = (ending[k - 1] >= (least if k > 1 else 1)) & (longest >= k)
            share = ALPHA ** (longest - k)[good] * ending[k - 1][good] / context[good]
            found[good], used[good] = np.log10(share), k
        row = np.repeat(np.arange(len(counts)), counts)
        micro = np.bincount(row, np.rint(found * 1e6), len(counts)).astype(np.int64)
        by_order = np.stack([np.bincount(row, used == k, len(counts)) for k in range(1, order + 1)], 1).astype(np.int64)
        return [pa.array(counts), pa.array(by_order.tolist(), pa.list_(pa.int64())), pa.array(micro)]

    answers = exchange.ask(chunks, keys_of, exchange.even_cuts(parts), totals)
    found = exchange.with_answers(
        chunks, answers, apply, "n_words long, n_by_order array<bigint>, score_micro long", bits=False)
    return found.select("carried.doc_id", "n_words", "n_by_order", "score_micro")
