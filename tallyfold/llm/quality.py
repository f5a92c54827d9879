"""Quality scores: a Gaussian kernel machine over statistics of texts, in closed form.

Each text becomes a row of STATISTICS, which alone travel on. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; each task sums its part of the normal equations
and Spark adds the parts up, so the ridge weights are fitted on every labelled row, whatever their
number. Ridge scores become probabilities by isotonic calibration: labelled rows held back from the
fit are counted per bin of the score, neighbouring bins that fall are pooled, and scores are read off
between the centres of the pools.

Cases: null and empty texts have statistics of 0 and are scored like any other; texts are read whole;
repeated documents are weighted rows; a document labelled more than once counts with its mean label;
null labels and null ids teach nothing. Without any labelled row all scores are 0.5. Only the id, the
text and, to learn, the label are read.
"""

import collections
import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import cut, kind, written

#: What is told of a text.
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "letters", "capitals", "digits", "blanks", "line_ends",
    "stops", "symbols", "distinct_words", "commonest_word", "repeated_word", "repeated_lines", "words_without_letters",
    "words_ending_in_symbols", "longest_word", "same_letter_runs",
)
FEATURES, RIDGE, SEED = 384, 1e-3, 13
#: Of the learning rows one in FOLDS is kept for calibration, in BINS bins; tasks that sum the equations.
FOLDS, BINS, PARTS = 4, 2000, 64
_LETTER, _CAPITAL, _DIGIT, _BLANK, _LINE, _STOP, _SYMBOL = range(7)


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    of = {"Lu": _CAPITAL, "Lt": _CAPITAL, "Nd": _DIGIT, "Nl": _DIGIT, "No": _DIGIT, "Zs": _BLANK, "Zl": _LINE, "Zp": _LINE}
    found = np.full(0x110000, _SYMBOL, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        found[c] = of.get(category, _LETTER if category[0] in "LM" else _SYMBOL)
    found[[9, 11, 12]], found[[10, 13]] = _BLANK, _LINE
    found[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
    return found


def statistics(text: str | None) -> list:
    """The STATISTICS of one whole text."""
    words = text.split() if text else ()
    if not words:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = _classes()[codes]
    share = np.bincount(kinds, minlength=7) / len(codes)
    letters = share[_LETTER] + share[_CAPITAL]
    lengths = np.array([len(w) for w in words])
    counts = collections.Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    # Where words end, and whether a word has a letter at all.
    solid = (kinds != _BLANK) & (kinds != _LINE)
    ends = np.flatnonzero(solid & ~np.append(solid[1:], False))
    begins = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
    lettered = np.add.reduceat((kinds <= _CAPITAL).astype(np.int64), begins) > 0 if len(begins) else np.zeros(1)
    return [
        np.log1p(len(codes)), np.log1p(n), lengths.mean(), lengths.std(), letters,
        share[_CAPITAL] / letters if letters else 0.0, share[_DIGIT], share[_BLANK], len(lines) / n, share[_STOP],
        share[_SYMBOL], np.log1p(len(counts)) / np.log1p(n), max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - lettered.mean(), float((kinds[ends] == _SYMBOL).mean()) if len(ends) else 0.0,
        np.log1p(lengths.max()), float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0,
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every row of docs."""

    def run(batches):
        for batch in batches:
            rows = [statistics(text.as_py()) for text in batch["text"]]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Model:
    """Standardising, random features, ridge weights and the calibration curve."""

    def __init__(self, mean, spread):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        # The kernel's width is the typical distance of two standardised rows.
        self.turn = rng.normal(size=(len(mean), FEATURES)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.curve = None, None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.ones(len(x)), np.cos(z @ self.turn + self.phase) * np.sqrt(2 / FEATURES)])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(x), *self.curve), 0, 1)


def isotonic(at: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and heights of the pools of the rising curve that fits the bins best (pool adjacent violators)."""
    pools = []
    for x, w, y in zip(at, n, positive):
        pools.append([x * w, w, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    sums, weights, heights = np.array(pools).T
    return sums / weights, heights / weights


def learn(rows: DataFrame) -> Model | None:
    """A model from described rows with a label y from 0 to 1: columns x and y. None without rows.

    Equal rows are one row with a weight; the fold is chosen by a hash of the row.
    """
    rows = rows.where("y IS NOT NULL").groupBy("x", "y").agg(F.count("*").cast("double").alias("w"))
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64("x", F.lit("fold")), F.lit(FOLDS)) == 0)
    rows = written(rows.repartition(PARTS, "x", "y").sortWithinPartitions("x", "y"))
    size = len(STATISTICS)
    moments = rows.agg(F.sum("w").alias("n"), *[F.sum(F.col("x")[k] * F.col("w")).alias(f"m{k}") for k in range(size)]).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m{k}"] for k in range(size)]) / moments["n"]
    squares = rows.agg(*[F.sum((F.col("x")[k] - F.lit(float(mean[k]))) ** 2 * F.col("w")) for k in range(size)]).first()
    model = Model(mean, np.sqrt(np.array(squares) / moments["n"]))

    def equations(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, w = model.features(_matrix(batch["x"])), batch["w"].to_numpy()
            total += (z * w[:, None]).T @ np.column_stack([z, batch["y"].to_numpy()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(FEATURES + 1), pa.int32()), "row": pa.array(list(total))})

    def summed(key, table):
        total = sorted(table["row"].to_pylist())
        return pa.Table.from_pydict({"i": pa.array([key[0].as_py()], pa.int32()), "row": [np.sum(total, 0)]})

    calibration = rows.where("calibrates")
    fitted = rows.where("NOT calibrates") if calibration.limit(1).count() else rows
    fitted = fitted if fitted.limit(1).count() else rows
    parts = fitted.select("x", "y", "w").mapInArrow(equations, "i int, row array<double>")
    found = parts.groupBy("i").applyInArrow(summed, "i int, row array<double>").orderBy("i").toPandas()
    both = np.stack(found["row"].to_numpy())
    penalty = RIDGE * both[0, 0] * np.eye(FEATURES + 1) / FEATURES
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(both[:, :-1] + penalty + 1e-12 * np.eye(FEATURES + 1), both[:, -1])

    def bins(batches):
        for batch in batches:
            at = np.clip(np.rint((model.ridge(_matrix(batch["x"])) + 0.5) / 2 * BINS), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(at), "n": batch["w"], "positive": pa.array(
                batch["w"].to_numpy() * batch["y"].to_numpy())})

    counted = (calibration if calibration.limit(1).count() else rows).select("x", "y", "w")
    counted = counted.mapInArrow(bins, "bin int, n double, positive double")
    counted = counted.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).orderBy("bin").toPandas()
    model.curve = isotonic(counted["bin"].to_numpy() * 2 / BINS - 0.5, counted["n"].to_numpy(), counted["positive"].to_numpy())
    return model


def labelled(rows: DataFrame, labels: DataFrame, label: str, learns: Column) -> DataFrame:
    """x, y of the described rows that may teach and have a label: the mean of their id's labels."""
    own = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    # Cut off, the labels are dealt out anew for the join, so that an id with many rows can be split there.
    own = cut(own.groupBy("doc_id").agg(F.avg("y").alias("y")))
    return rows.where(learns).join(own, "doc_id").select("x", "y")


def scores(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every described row."""

    def run(batches):
        for batch in batches:
            found = model.score(_matrix(batch["x"])) if model and len(batch) else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind(rows, 'doc_id')}, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in four is held out from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
