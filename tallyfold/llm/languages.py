"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language in order of rank; n-grams lie within
words, one blank stands for each word's border. A document's own profile is compared with each
language's by the out-of-place distance: the sum over its n-grams of how far the ranks lie apart, and
the greatest distance for those that the language's profile lacks. The nearest language wins, ties
go to the smaller name.

Cases: a null text, or one without letters, is `und` with score 0; without any labelled rows every
document is; texts are read whole; repeated rows stay; n-grams of equal frequency are ranked by
their code points; only the id, the text and, to learn, the label are read.
"""

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import kind

UNDETERMINED = "und"
#: What stands for a border of a word; no letter has this code.
BORDER = 1
#: Characters whose n-grams are counted at a time, whatever the length of the text.
PIECE = 1 << 18
#: n-grams in a language's profile and in a document's.
PROFILE = 400
#: Labelled documents that each language is learned from, on average, and languages learned, the most
#: frequent ones: the bounds of the sample.
SAMPLE, LANGUAGES = 3000, 1000


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str):
    """Codes of the 1- to 3-grams, 21 bits a character, in pieces of the text; 1 stands for a border of a word.

    The border is not 0, so that a letter that begins a word has another code than the letter alone.
    """
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    c = np.where(_letters()[c], c, np.uint32(BORDER))
    c = c[np.append(True, (c[1:] != BORDER) | (c[:-1] != BORDER))]
    for start in range(0, len(c), PIECE):
        # Two characters more, for the n-grams that begin in this piece and end in the next.
        d = c[start:start + PIECE + 2].astype(np.uint64)
        pairs = d[:-1] << np.uint64(21) | d[1:]
        triples = pairs[:-1] << np.uint64(21) | d[2:]
        single = d[:PIECE]
        yield np.concatenate([single[single != BORDER], pairs[:PIECE], triples[d[1:-1] != BORDER]])


def merged(counted: list):
    """The sums of counts (codes, counts), by rising code."""
    if len(counted) == 1:
        return counted[0]
    codes, at = np.unique(np.concatenate([codes for codes, _ in counted]), return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, at, np.concatenate([counts for _, counts in counted]))
    return codes, sums


def counts_of(text: str):
    """The text's distinct n-grams by rising code, and how often each occurs."""
    return merged([np.unique(piece, return_counts=True) for piece in ngrams(text)])


def profile(text: str, size: int) -> np.ndarray:
    """The text's most frequent n-grams by falling frequency, ties by code."""
    codes, counts = counts_of(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, label: str = "lang", size: int = PROFILE, sample: int = SAMPLE) -> pd.DataFrame:
    """Profiles (lang, gram, rank) learned from labelled rows: at most `size` rows a language.

    Each language is learned from about `sample` of its rows, chosen by a hash of the id.
    """
    rows = docs.select("doc_id", "text", F.col(label).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return pd.DataFrame({"lang": [], "gram": [], "rank": []})
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], sample / r["n"])])
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    rows = rows.where(turn < F.try_element_at(shares, F.col("lang"))).select("lang", "text")

    def count(batches):
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), np.array(batch["lang"].to_pylist(), object)
            for lang in sorted(set(langs)):
                codes, counts = merged([counts_of(texts[i]) for i in np.flatnonzero(langs == lang)])
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes.astype(np.int64)),
                    "n": pa.array(counts.astype(np.int64))})

    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return grams.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank").toPandas()


def _judge(profiles: pd.DataFrame, size: int):
    """A function from a text to its language and score."""
    langs = sorted(profiles["lang"].unique())
    grams = np.unique(profiles["gram"].to_numpy().astype(np.uint64))
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int16)
    for k, lang in enumerate(langs):
        own = profiles[profiles["lang"] == lang]
        ranks[np.searchsorted(grams, own["gram"].to_numpy().astype(np.uint64)), k] = own["rank"]

    def judge(text):
        own = profile(text, size) if text and langs else ()
        if len(own) == 0 or not own.any():
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        of = ranks[np.where(grams[at] == own, at, len(grams))]
        apart = np.where(of < 0, size, np.minimum(size, np.abs(of - np.arange(len(own))[:, None]))).sum(0)
        best = int(np.argmin(apart))
        rest = np.delete(apart, best)
        against = rest.min() if len(rest) else size * len(own)
        return langs[best], float(1 - apart[best] / against) if against else 0.0

    return judge


def identify(docs: DataFrame, profiles: pd.DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs.

    score: 1 less the ratio of the nearest language's distance to that of the next (of the greatest
    distance, where there is one language only); from 0 to 1.
    """
    judge = _judge(profiles, size)

    def run(batches):
        for batch in batches:
            found = [judge(text.as_py()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind(docs, 'doc_id')}, lang_pred string, score double")


def determined(docs: DataFrame, profiles: pd.DataFrame, size: int = PROFILE) -> DataFrame:
    """The rows of docs, with all their columns, whose language can be told.

    Without profiles nothing speaks against a text: only null texts and those without letters go.
    """
    judge = _judge(profiles, size)
    if not len(profiles):
        def judge(text):
            return (None if text and len(counts_of(text)[0]) else UNDETERMINED), 0.0

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([judge(text.as_py())[0] != UNDETERMINED for text in batch["text"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """One document in five is held out from learning; so is one without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
