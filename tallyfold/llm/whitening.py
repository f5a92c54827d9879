"""Whitening of embeddings with an exact integer covariance from bit planes.

An entry c becomes the whole number x = floor(1024 c) + 100000. Each task shifts the x-vectors of a
batch to start at 0 in every dimension, packs each bit of each dimension across the rows into words,
and counts the ones that two planes share: the counts, weighted by the planes' powers of two, are the
exact sums of products, whatever their size. Spark adds the tasks' sums up; the covariance is centred
in whole numbers and only then divided, so that no digit is lost to the offset. Its eigenvectors, as
many as are asked for, project the centred vectors.

Cases: rows whose vector is null, or holds null or non-finite entries, are dropped. Vectors of one
length are a fit list of their own; empty vectors have no components. A component along which nothing
varies (an eigenvalue of at most FLAT of the trace) has no rows, so a list of equal vectors has none.
|1024 c| beyond 2^42 counts as 2^42. Repeated rows and null ids stay and count. Only the id and the
vector are read. What reaches the driver is one number per pair of dimensions.
"""

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import kind

OFFSET, SCALE, WIDEST = 100_000, 1024, 2.0 ** 42
#: Share of the trace up to which an eigenvalue counts as 0.
FLAT = 1e-10
#: Rows whose planes are packed at once.
ROWS = 16_384


def whole_vectors(frame: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and u = floor(1024 c), without the offset, of the rows that take part."""
    own = frame.select("vec_id", F.col(column).cast("array<double>").alias("c"))
    own = own.where(F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    near = lambda c: F.greatest(F.least(c * SCALE, F.lit(WIDEST)), F.lit(-WIDEST))
    return own.select("vec_id", F.transform("c", lambda c: F.floor(near(c))).alias("u"))


def matrices(batch):
    """(positions, matrix) of the rows of each length that occurs in an Arrow batch, but 0."""
    lists = batch["u"]
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.values.to_numpy()
    starts = lists.offsets.to_numpy()[:-1]
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        for cut in range(0, len(at), ROWS):
            own = at[cut:cut + ROWS]
            yield own, values[starts[own][:, None] + np.arange(size)]


def products(u: np.ndarray) -> np.ndarray:
    """The exact sums over rows of u_i * u_j, as Python integers, by AND and popcount of bit planes."""
    rows, size = u.shape
    least = u.min(0)
    y = (u - least).astype(np.uint64)
    bits = max(1, int(y.max()).bit_length())
    words = -(-rows // 64)
    planes = np.zeros((size, bits, words * 8), np.uint8)
    for b in range(bits):
        ones = np.packbits((y.T >> np.uint64(b)).astype(np.uint8) & 1, axis=1)
        planes[:, b, :ones.shape[1]] = ones
    planes = planes.view(np.uint64).reshape(size * bits, words)
    shared = np.zeros((size, size), object)
    weights = np.array([1 << b for b in range(bits)], object)
    for i in range(size):
        both = np.stack([np.bitwise_count(planes[i * bits + a] & planes[i * bits:]).sum(1, dtype=np.int64)
                         for a in range(bits)]).reshape(bits, size - i, bits)
        shared[i, i:] = np.einsum("a,ajb,b->j", weights, both.astype(object), weights)
        shared[i:, i] = shared[i, i:]
    sums = y.sum(0, dtype=object)
    m = least.astype(object)
    return shared + np.outer(m, sums) + np.outer(sums, m) + rows * np.outer(m, m)


def scatter(vectors: DataFrame) -> DataFrame:
    """size, i, j, total: sums of products per pair i <= j; i = -1: sums per j, and the number of rows at j = -1."""

    def run(batches):
        found = {}
        for batch in batches:
            for _, u in matrices(batch):
                both = products(u)
                sums = u.astype(object).sum(0)
                n, s, p = found.get(u.shape[1], (0, 0, 0))
                found[u.shape[1]] = n + len(u), s + sums, p + both
        for size, (n, s, p) in found.items():
            i, j = np.triu_indices(size)
            total = [n, *s, *p[i, j]]
            yield pa.RecordBatch.from_pydict({
                "size": pa.array([size] * len(total), pa.int32()),
                "i": pa.array([-1] * (size + 1) + i.tolist(), pa.int32()),
                "j": pa.array([-1, *range(size)] + j.tolist(), pa.int32()),
                "total": pa.array([decimal.Decimal(int(x)) for x in total], pa.decimal128(38, 0))})

    found = vectors.select("u").mapInArrow(run, "size int, i int, j int, total decimal(38,0)")
    return found.groupBy("size", "i", "j").agg(F.sum("total").alias("total"))


class Fit:
    """What one fit list says: n, the sums, and up to `top` components with their variances."""

    def __init__(self, size: int, rows: list, top: int):
        total = {(r["i"], r["j"]): int(r["total"]) for r in rows}
        self.n = total[-1, -1]
        self.sums = np.array([total[-1, j] for j in range(size)], object)
        own = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                own[i, j] = own[j, i] = (self.n * total[i, j] - self.sums[i] * self.sums[j]) / self.n ** 2
        values, vectors = np.linalg.eigh(own)
        trace = own.trace()
        best = [k for k in np.argsort(-values, kind="stable")[:top] if values[k] > FLAT * trace]
        self.explained = values[best] / trace if trace else np.zeros(0)
        self.project = vectors[:, best] / np.sqrt(values[best])

    def spread(self, u: np.ndarray) -> np.ndarray:
        """n * x - S per entry, exactly."""
        most = self.n * int(np.abs(u).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        if most < 2 ** 62:
            return u * np.int64(self.n) - self.sums.astype(np.int64)
        return u.astype(object) * self.n - self.sums

    def whitened(self, spread: np.ndarray) -> np.ndarray:
        return (spread / self.n).astype(np.float64) @ self.project


def deviations(spread: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each row."""
    if spread.dtype != object and int(np.abs(spread).max(initial=0)) ** 2 * spread.shape[1] >= 2 ** 63:
        spread = spread.astype(object)
    return (spread * spread).sum(1)


def fit(vectors: DataFrame, top: int = 8) -> dict[int, Fit]:
    """The fit of every length of vectors that occurs."""
    rows = scatter(vectors).collect()
    return {size: Fit(size, [r for r in rows if r["size"] == size], top) for size in {r["size"] for r in rows}}


def identity_errors(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length, the largest absolute entry of the whitened vectors' measured covariance less the identity."""

    def run(batches):
        found = {}
        for batch in batches:
            for _, u in matrices(batch):
                w = fits[u.shape[1]].whitened(fits[u.shape[1]].spread(u))
                w = np.column_stack([np.ones(len(w)), w])
                found[u.shape[1]] = found.get(u.shape[1], 0) + w.T @ w
        for size, both in found.items():
            i, j = np.triu_indices(len(both))
            yield pa.RecordBatch.from_pydict({
                "size": pa.array([size] * len(i), pa.int32()), "i": pa.array(i, pa.int32()),
                "j": pa.array(j, pa.int32()), "total": pa.array(both[i, j])})

    found = vectors.select("u").mapInArrow(run, "size int, i int, j int, total double")
    rows = found.groupBy("size", "i", "j").agg(F.sum("total").alias("total")).collect()
    errors = {}
    for size, own in fits.items():
        k = own.project.shape[1]
        both = np.zeros((k + 1, k + 1))
        for r in rows:
            if r["size"] == size:
                both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["total"] / own.n
        apart = both[1:, 1:] - np.outer(both[0, 1:], both[0, 1:]) - np.eye(k)
        errors[size] = float(np.abs(apart).max(initial=0))
    return errors


def whiten(frame: DataFrame, top: int = 8, column: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    deviation is decimal(38,0); components are numbered from 1 by falling variance.
    """
    vectors = whole_vectors(frame, column)
    fits = fit(vectors, top)
    errors = identity_errors(vectors, fits)

    def run(batches):
        for batch in batches:
            for at, u in matrices(batch):
                own = fits[u.shape[1]]
                k = own.project.shape[1]
                if not k:
                    continue
                spread = own.spread(u)
                rows = len(u)
                apart = pa.array([decimal.Decimal(int(x)) for x in deviations(spread)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch["vec_id"].take(pa.array(at)).take(each),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, own.n)), "deviation": apart.take(each),
                    "whitened": pa.array(own.whitened(spread).reshape(-1)),
                    "explained": pa.array(np.tile(own.explained, rows)),
                    "identity_error": pa.array(np.full(rows * k, errors[u.shape[1]]))})

    return vectors.mapInArrow(
        run, f"vec_id {kind(frame, 'vec_id')}, component int, n long, deviation decimal(38,0), whitened double, "
             "explained double, identity_error double")
