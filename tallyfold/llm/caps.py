"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it if it lies in the cap around it (product at least
`height`). The directions are a product code: the dimensions are dealt to blocks, each block has a
small random code, and every combination of code words is a direction. A vector's filters are found
by list decoding: block by block the partial sums that can still reach the height are kept, so the
work follows the number of filters passed and not that of directions. Vectors are joined on filters,
and pairs that meet are verified by their cosine in double precision. The height follows from the
number of vectors, so that a filter holds about `BUCKET` of them at every size, and the number of
directions from the wanted number of filters that two vectors at the limit share.

Vectors do not travel to all their filters. A sketch does, half the coordinates of a rotation in a
byte each and the length of the rest, from which the cosine is bounded from above; only entries that
may have a partner in a filter are brought together there with whole vectors. No pair at or above the
limit fails the bound.

Equal vectors are one entry with a weight. A filter's entries are split into blocks and blocks are
paired, so that no task gets a crowded filter. A pair is counted in the first of the filters it
shares. A task gives the number of links of each entry and links that span what is connected.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
are components of their own; vectors link with those of their own length; rows without an id take no
part in links and have no component; rows of one id are rows of their own; other columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import components, cut, kind, local_components, paired_blocks, whole_runs

#: Vectors that a filter holds on average, and entries of a block.
BUCKET, BLOCK = 128, 1024
#: Filters that two vectors at the limit share on average: e to the minus this is the share of links lost.
SHARED = 18.0
SEED = 20


def _beyond(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


class ProductCode:
    """The filters for vectors of one dimension."""

    def __init__(self, dimension: int, vectors: int, limit: float):
        share = min(0.1, BUCKET / max(1, vectors))
        grid = np.linspace(-1, 1, 200_001)
        density = (1 - grid * grid) ** ((dimension - 3) / 2) if dimension > 3 else np.ones(len(grid))
        tail = np.cumsum(density[::-1])[::-1] / density.sum()
        height = float(grid[np.searchsorted(-tail, -share)])
        # Of two vectors at the limit, the second passes a filter that the first just passes with this chance.
        side = math.sqrt(1 - limit * limit) * math.sqrt(1 - height * height) / math.sqrt(max(1, dimension - 1))
        both = _beyond((1 - limit) * height / side)
        filters = math.ceil(SHARED / both / share)
        self.blocks = min(dimension, max(1, math.ceil(math.log(filters) / math.log(100))))
        self.words = max(2, math.ceil(filters ** (1 / self.blocks)))
        # Products of unit blocks average 1: a direction is their sum over the root of the number of blocks.
        self.height = height * math.sqrt(self.blocks)
        rng = np.random.default_rng(SEED)
        turn = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        self.turn, self.kept = turn, (dimension + 1) // 2
        self.codes = []
        for part in np.array_split(np.arange(dimension), self.blocks):
            code = rng.normal(size=(self.words, len(part)))
            self.codes.append(turn[:, part] @ (code / np.linalg.norm(code, axis=1, keepdims=True)).T)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the rows of x pass, by row, then filter."""
        products = [x @ code for code in self.codes]
        most = [p.max(1) for p in products]
        rest = np.append(np.cumsum(most[::-1], 0)[::-1][1:], np.zeros((1, len(x))), 0)
        row, name, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, p in enumerate(products):
            sums = total[:, None] + p[row]
            at, word = np.nonzero(sums + rest[k][row][:, None] >= self.height)
            row, name, total = row[at], name[at] * self.words + word, sums[at, word]
        return row, name


    def sketch(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kept coordinates in steps of 1/127, and the length of the others."""
        turned = x @ self.turn
        rest = np.sqrt(np.maximum(0, (turned[:, self.kept:] ** 2).sum(1)))
        return np.rint(turned[:, :self.kept] * 127).astype(np.int8), rest.astype(np.float32)

    def slack(self) -> float:
        """How much rounding can take off a product of sketches, at most."""
        error = math.sqrt(self.kept) / 254
        return 2 * error + error * error + 1e-5


def _unit(column, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, width).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _met_before(row, name, a, b) -> np.ndarray:
    """Which pairs (a, b) of positions share one of the filters given as (row, name)."""
    rows = np.unique(np.concatenate([a, b]))
    place = np.searchsorted(rows, row)
    own = (place < len(rows)) & (rows[np.minimum(place, len(rows) - 1)] == row)
    place, name = place[own], name[own]
    _, name, times = np.unique(name, return_inverse=True, return_counts=True)
    common = times > 1
    place, name = place[common[name]], (np.cumsum(common) - 1)[name[common[name]]]
    met = np.zeros((len(rows), len(rows)), bool)
    for start in range(0, int(common.sum()), 4096):
        part = (name >= start) & (name < start + 4096)
        holds = np.zeros((len(rows), 4096), np.float32)
        holds[place[part], name[part] - start] = 1
        met |= holds @ holds.T > 0
    return met[np.searchsorted(rows, a), np.searchsorted(rows, b)]


def _verified(row, name, here, x, side, crossing, limit):
    """Pairs of positions in one filter's block pair at or above the limit, counted here.

    (row, name) are the filters that each position passes; a pair is counted in its first.
    """
    if crossing:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = np.nonzero(x[left] @ x[right].T >= limit)
        a, b = left[a], right[b]
    else:
        a, b = np.nonzero(np.triu(x @ x.T >= limit, 1))
    if len(a):
        below = name < here
        first = ~_met_before(row[below], name[below], a, b)
        a, b = a[first], b[first]
    return a, b


def links(vectors: DataFrame, width: int, count: int, limit: float) -> DataFrame:
    """(id, n_links, partner) from vectors (id long, weight long, x array of numbers), all distinct.

    n_links adds up over the rows of an id; partner is a linked entry or the id itself.
    """
    code = ProductCode(width, count, limit)

    def pass_filters(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                x = _unit(part["x"], width)
                row, name = code.decode(x)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                filters = pa.ListArray.from_arrays(pa.array(ends), pa.array(name))
                coarse, rest = code.sketch(x)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["weight"], part["x"], filters,
                     pa.array([c.tobytes() for c in coarse], pa.binary()), pa.array(rest)],
                    ["id", "weight", "x", "filters", "coarse", "rest"])

    passed = cut(vectors.mapInArrow(
        pass_filters, f"id long, weight long, x {kind(vectors, 'x')}, filters array<long>, coarse binary, rest float"))
    order = ["filter", "block_a", "block_b"]

    def ends_of(table):
        names, block_a, block_b = (table[n].to_numpy() for n in order)
        new = np.flatnonzero((np.diff(names) != 0) | (np.diff(block_a) != 0) | (np.diff(block_b) != 0)) + 1
        return names, block_a != block_b, zip([0, *new.tolist()], [*new.tolist(), len(names)])

    def maybe(batches):
        for table in whole_runs(batches, order):
            names, crossing, runs = ends_of(table)
            side, ids, rest = (table[n].to_numpy() for n in ("side", "id", "rest"))
            coarse = np.frombuffer(b"".join(table["coarse"].to_pylist()), np.int8).reshape(len(ids), -1) / np.float32(127)
            kept = np.zeros(len(ids), bool)
            for lo, hi in runs:
                own, r = coarse[lo:hi], rest[lo:hi]
                bound = own @ own.T + r[:, None] * r[None, :] >= limit - code.slack()
                bound &= side[lo:hi, None] != side[None, lo:hi] if crossing[lo] else ~np.eye(hi - lo, dtype=bool)
                kept[lo:hi] = bound.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(names[kept]), pa.array(ids[kept])], ["filter", "id"])

    sketched = passed.select("id", "coarse", "rest", F.explode("filters").alias("filter"))
    met = paired_blocks(sketched, "filter", "id", BLOCK).select(*order, "side", "id", "coarse", "rest")
    met = met.repartition(*map(F.col, order)).sortWithinPartitions(*order).mapInArrow(maybe, "filter long, id long")
    spread = paired_blocks(cut(met.distinct()), "filter", "id", BLOCK).join(
        passed.select("id", "weight", "x", "filters"), "id").select(*order, "side", "id", "weight", "x", "filters")

    def verify(batches):
        for table in whole_runs(batches, order):
            names, crossing, runs = ends_of(table)
            side, ids, weights = (table[n].to_numpy() for n in ("side", "id", "weight"))
            lists = table["filters"].combine_chunks()
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            x = _unit(table["x"].combine_chunks(), width)
            left, right = [], []
            for lo, hi in runs:
                own = slice(lo, hi)
                row = np.repeat(np.arange(hi - lo), sizes[own])
                a, b = _verified(row, flat[starts[lo]:starts[lo] + sizes[own].sum()], names[lo], x[own], side[own], crossing[lo], limit)
                left.append(a + lo)
                right.append(b + lo)
            a, b = np.concatenate(left), np.concatenate(right)
            n = (np.bincount(a, weights[b], len(ids)) + np.bincount(b, weights[a], len(ids))).astype(np.int64)
            partner = ids[local_components(len(ids), a, b)]
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(n[at]), pa.array(partner[at])], ["id", "n_links", "partner"])

    return spread.repartition(*map(F.col, order)).sortWithinPartitions(*order).mapInArrow(
        verify, "id long, n_links long, partner long")


def near_duplicates(embeddings: DataFrame, limit: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding)."""
    x = F.col("embedding")
    rows = embeddings.select("vec_id", x.alias("x"))
    x = F.col("x")
    fine = (F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.exists("x", lambda v: v != 0)
            & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = cut(rows.select("vec_id", F.when(fine, F.col("x")).alias("x")))
    classes = cut(rows.where("x IS NOT NULL").groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    found = None
    # Vectors of each length have filters of their own.
    for r in classes.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).where("n > 1").orderBy("width").collect():
        own = classes.where(F.size("x") == r["width"]).select("id", "weight", "x")
        one = cut(links(own, r["width"], r["n"], limit))
        found = one if found is None else found.union(one)
    if found is None:
        named = classes.select("x", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        counts = found.groupBy("id").agg(F.sum("n_links").alias("n"))
        joined = components(found.select(F.col("id").alias("a"), F.col("partner").alias("b")))
        named = classes.join(counts, "id", "left").join(joined, F.col("id") == F.col("node"), "left").select(
            "x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("x IS NOT NULL").join(cut(named), "x").select("vec_id", "n_links", "component_id")
    alone = rows.where("x IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
