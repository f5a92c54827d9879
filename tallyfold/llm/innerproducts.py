"""Exact top-k by inner product: vectors in falling length, with bounds from rotated partial sums.

Candidates are cut into bands by falling length, queries into blocks; a task gets one block and one
band, and goes through the band from the longest vector down. The k-th best score so far is a query's
threshold. As soon as |q| times the longest remaining length is below it (Cauchy-Schwarz), the query
is done. Before exact scores, both sides are rotated onto the principal directions of all candidates
(eigenvectors of their Gram matrix), so that few leading coordinates hold most of the product; the
rest is bounded by the product of the residual lengths. What stays possible is scored exactly. The
longest band goes first and gives the thresholds for the others.

Cases: vectors that are null or empty or hold null take no part; shorter vectors count as filled up
with zeros; equal scores go to the smaller id; a candidate with the query's id is its own row;
fewer candidates than k give fewer rows; other columns are not read. Scores are exact while the
product of two lengths stays below 2^53.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import cut

BAND_ROWS, BLOCK_ROWS, CHUNK = 16_384, 2_048, 2_048
FOUND = "query_id long, vec_id long, score long"


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def principal_directions(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: orthonormal directions by falling weight. Tasks send width x width sums, added up by Spark."""

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch["v"], width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "total"])

    sums = vectors.select("v").mapInArrow(gram, "at long, total double").groupBy("at").agg(F.sum("total").alias("total"))
    total = np.zeros(width * width)
    for r in sums.collect():
        total[r["at"]] = r["total"]
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_band(q, q_ids, floor, x, x_ids, directions, k: int) -> list:
    """For each query the best (scores, ids) of the band that reach its floor, ties to smaller ids."""
    lengths = np.sqrt((x * x).sum(1))
    order = np.lexsort((x_ids, -lengths))
    x, x_ids, lengths = x[order], x_ids[order], lengths[order]
    head = max(1, q.shape[1] // 4)
    qr, xr = q @ directions, x @ directions
    q_len, q_rest = np.sqrt((q * q).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
    x_rest = np.sqrt((xr[:, head:] ** 2).sum(1))
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in q_ids]
    floor = floor.copy()
    for a in range(0, len(x), CHUNK):
        b = a + CHUNK
        slack = 1e-9 * q_len * lengths[a] + 1e-6
        alive = np.flatnonzero(q_len * lengths[a] + slack >= floor)
        if not len(alive):
            break
        bound = qr[alive, :head] @ xr[a:b, :head].T + q_rest[alive, None] * x_rest[None, a:b]
        possible = (bound + slack[alive, None] >= floor[alive, None]) & (q_ids[alive, None] != x_ids[None, a:b])
        if possible.mean() > 0.02:
            scores = q[alive] @ x[a:b].T
            possible &= scores >= floor[alive, None]
            row, at = np.nonzero(possible)
            scores = scores[row, at]
        else:
            row, at = np.nonzero(possible)
            scores = np.einsum("ij,ij->i", q[alive[row]], x[a + at])
            fine = scores >= floor[alive[row]]
            row, at, scores = row[fine], at[fine], scores[fine]
        ends = np.searchsorted(row, np.arange(len(alive) + 1))
        for i, query in enumerate(alive):
            lo, hi = ends[i], ends[i + 1]
            if lo == hi:
                continue
            s = np.concatenate([best[query][0], scores[lo:hi]])
            ids = np.concatenate([best[query][1], x_ids[a + at[lo:hi]]])
            top = _best(s, ids, k)
            best[query] = s[top], ids[top]
            if len(top) == k:
                floor[query] = max(floor[query], s[top[-1]])
    return best


def top_k(queries: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for queries and items (vec_id long, v array<long>)."""
    usable = "vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)"
    items = cut(items.select("vec_id", "v").where(usable))
    queries = cut(queries.select("vec_id", "v").where(usable))
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    stats = items.select(F.size("v").alias("w"), squared.alias("l")).agg(F.count("*").alias("n"), F.max("w").alias("w")).first()
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max(stats.w or 0, asked.w or 0)
    bands = max(1, -(-stats.n // BAND_ROWS))
    blocks = max(1, -(-asked.n // BLOCK_ROWS))
    directions = principal_directions(items, width)
    shares = [k_ / bands for k_ in range(1, bands)]
    bounds = items.agg(F.percentile_approx(squared, shares, 100 * bands).alias("b")).first().b if shares else []
    bounds = sorted(bounds or [], reverse=True)
    # Lengths on a bound, equal as they are, are spread over all bands that the bound begins and ends.
    limits = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    over = F.size(F.filter(limits, lambda b: b > F.col("l")))
    same = F.size(F.filter(limits, lambda b: b == F.col("l")))
    items = items.withColumn("l", squared).withColumn("band", over + F.pmod(F.xxhash64("vec_id"), same + 1).cast("int"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def search(asking: pa.Table, band: pa.Table) -> pa.Table:
        q_ids, floor = asking["vec_id"].to_numpy(), asking["floor"].to_numpy()
        if not len(q_ids) or not band.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        best = search_band(_matrix(asking["v"], width), q_ids, floor, _matrix(band["x"], width),
                           band["item"].to_numpy(), directions, k)
        return pa.table({
            "query_id": pa.array(np.repeat(q_ids, [len(s) for s, _ in best])),
            "vec_id": pa.array(np.concatenate([ids for _, ids in best])),
            "score": pa.array(np.concatenate([s for s, _ in best]).astype(np.int64))})

    def grid(asking, which, first, last):
        """Each block of queries meets each of the bands first to last - 1 in a task of its own."""
        left = asking.select("vec_id", "v", "floor", "block", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("band"))
        right = which.select(F.col("vec_id").alias("item"), F.col("v").alias("x"), "band", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        return left.groupBy("block", "band").cogroup(right.groupBy("block", "band")).applyInArrow(search, FOUND)

    none = queries.withColumn("floor", F.lit(float("-inf")))
    found = cut(grid(none, items.where("band = 0"), 0, 1))
    if bands > 1:
        floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
        floors = floors.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("s").cast("double").alias("floor"))
        asking = queries.join(floors, "vec_id", "left").na.fill({"floor": float("-inf")})
        found = found.union(grid(asking, items.where("band > 0"), 1, bands))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
