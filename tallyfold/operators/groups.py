"""Building blocks that keep one huge group from landing in one task, alike for every size."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import shared_folder

# Groups with more than this share of all rows are numbered in pieces.
PIECES = 128
# Rows that one task sorts without spilling, and rows for each of the first tasks, while they are few.
TASK_ROWS, FEW_ROWS, FEW_TASKS = 1_000_000, 250_000, 200


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The same rows as a table in a new shared folder, for what reads them several times."""
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def attach(df: DataFrame, per_key: DataFrame, keys: list) -> DataFrame:
    """Left join with a table of one row per key.

    An aggregate on the same keys would be joined where it stands, and a frequent key could not
    be split.  Dealt out anew, both sides of the join come out of a shuffle of its own, and
    adaptive execution splits the partitions of frequent keys.
    """
    return df.join(per_key.hint("rebalance"), keys, "left")


def pieces(measured: DataFrame, keys: list, along: str):
    """What cuts groups with a large share of the rows, and the number of rows: ``(cut, rows)``.

    Groups with more than one in ``PIECES`` of all rows - there are fewer than ``PIECES`` - are found by
    a count that runs at once. ``cut`` gives the piece that a value of ``along`` is in: between which
    quantiles of the rows of these groups it lies, 0 in all other groups. It is None where all groups
    are small: then each is as small as a piece. A value is compared with seven quantiles, halving what
    is left, in generated code.
    """
    seen = Observation()
    counts = measured.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("rows"))
    largest = counts.orderBy(F.desc("_n")).limit(PIECES).collect()
    rows = seen.get["rows"] or 0
    large = [r for r in largest if r["_n"] * PIECES > rows]
    if not large:
        return None, rows

    def is_large():
        return reduce(Column.__or__, [
            reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]) for r in large])

    shares = [k / PIECES for k in range(1, PIECES)]
    found = measured.where(is_large()).agg(
        F.percentile_approx(F.col(along).cast("double"), shares, 20 * PIECES).alias("cuts"))
    cuts = sorted(set(found.first().cuts or []))

    def cut(value: Column) -> Column:
        value = value.cast("double")

        def between(low, high):
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(value > cuts[middle], between(middle + 1, high)).otherwise(between(low, middle))

        return F.when(is_large(), between(0, len(cuts))).otherwise(0)

    return cut, rows


def dealt(df: DataFrame, keys: list, rows: int) -> DataFrame:
    """Rows of one key together, in as many partitions as their number asks for."""
    parts = max(-(-rows // TASK_ROWS), min(FEW_TASKS, -(-rows // FEW_ROWS)), 1)
    return df.repartition(parts, *keys)


def index(
    df: DataFrame, keys: list, order: list, out: str, along: str, leading: tuple = (),
    measured: DataFrame = None,
) -> DataFrame:
    """Number the rows of each group from 1 in the given order.

    ``order`` begins with the columns ``leading``, then the number ``along``. A group with a large share
    of the rows (of ``measured``, if given, which has the same keys and column, and no fewer rows) is cut
    into as many pieces as its share, however sparse the values are. Each piece is numbered on its own;
    only sizes of pieces meet.
    """
    cut, _ = pieces(df if measured is None else measured, keys, along)
    return numbered(df, keys, order, out, along, cut, leading)


def numbered(df: DataFrame, keys: list, order: list, out: str, along: str, cut, leading: tuple = ()) -> DataFrame:
    """``index`` with what ``pieces`` found before."""
    if cut is None:
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, turn.cast("bigint"))
    parts = [*leading, "_piece"]
    cut_up = df.withColumn("_piece", cut(F.col(along)))
    local = F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*order))
    ahead = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_up.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_size")).select(
        *keys, *parts, F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before")
    )
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, *parts)]
    met = cut_up.withColumn("_local", local).alias("a").join(sizes.alias("b"), same)
    return met.select(
        *[F.col(f"a.{c}") for c in df.columns],
        (F.col("_local") + F.col("_before")).cast("bigint").alias(out),
    )


def previous(df: DataFrame, keys: list, order: list, along: str, value: Column, out: str) -> DataFrame:
    """The value of the row before, within each group in the given order; null for the first.

    ``order`` begins with the number ``along``, whose range is cut into pieces as in ``index``. Each
    piece looks back on its own; the first row of a piece takes the last value of the pieces before,
    of which there are at most ``PIECES`` a group.
    """
    cut, _ = pieces(df, keys, along)
    if cut is None:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    cut_up = df.withColumn("_piece", cut(F.col(along))).withColumn("_value", F.struct(value.alias("v")))
    local = F.lag("_value").over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    ends = cut_up.groupBy(*keys, "_piece").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    ahead = Window.partitionBy(*keys).orderBy("_piece")
    ends = ends.select(*keys, "_piece", F.lag("_end").over(ahead).alias("_before"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_piece")]
    met = cut_up.withColumn("_local", local).alias("a").join(ends.alias("b"), same)
    return met.select(*[F.col(f"a.{c}") for c in df.columns], F.coalesce("_local", "_before")["v"].alias(out))
