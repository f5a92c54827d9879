"""What several operators of this subpackage share: cut lineage, components, numbering, blocks."""

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes sure of a checkpoint folder: the cluster's own; a temporary one only on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyfold-checkpoint-")
    context.setCheckpointDir(folder)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and free of their lineage."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to a new folder within the shared checkpoint folder."""
    spark = frame.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    frame.write.parquet(path)
    return spark.read.parquet(path)


def tidied(of, *group):
    """What of(*group) gives, after which its memory goes back to the system: workers live on, idle or with other tasks."""
    import pyarrow as pa

    found = of(*group)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return found


def kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        a, b = a[open_], b[open_]
    return label


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by the links (a, b), for every linked node.

    Large and small stars in turn (a logarithmic number of rounds); the links shrink to one per
    node. Each round is checkpointed. Links to itself and null ends count as none. The minima come out
    of a shuffle of their own, so that adaptive execution can split the join of a node of many links.
    """
    links = cut(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least.hint("rebalance"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("rebalance"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            small.select("a", F.col("m").alias("b")))
        links = cut(small.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def numbered(frame: DataFrame, group: list, order: list, buckets: int, column: str = "position") -> DataFrame:
    """Adds a gapless number from 0 within each group, in pieces, so that no group meets in one task.

    The pieces are hash buckets of the order columns; the number follows piece, then order.
    """
    frame = frame.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "_piece"]
    sizes = frame.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    ranked = frame.withColumn("_within", within).alias("l").join(starts.alias("r"), condition)
    return ranked.select("l.*", (F.col("_within") - 1 + F.col("_before")).alias(column)).drop("_piece", "_within")


def whole_runs(batches, keys: list):
    """The rows of sorted Arrow batches, cut only between runs of equal keys, as tables of one batch."""
    import pyarrow as pa

    kept = []

    def table():
        return pa.Table.from_batches(kept).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and any(kept[-1][k][-1] != batch[k][0] for k in keys):
            yield table()
            kept = []
        new = np.flatnonzero(np.any([np.diff(batch[k].to_numpy()) != 0 for k in keys], axis=0))
        if len(new):
            kept.append(batch.slice(0, int(new[-1]) + 1))
            yield table()
            kept = [batch.slice(int(new[-1]) + 1)]
        else:
            kept.append(batch)
    if kept:
        yield table()


def paired_blocks(frame: DataFrame, group: str, item: str, rows: int) -> DataFrame:
    """Splits every group of at least two rows into blocks of about `rows` and pairs the blocks.

    Adds block_a <= block_b and side (0 or 1); a task gets one pair of blocks, never a group. Any
    two rows of a group meet in exactly one pair with block_a < block_b, or in their own block's.
    """
    # Cut off, the sizes are dealt out anew for the join, so that a crowded group can be split there.
    sizes = cut(frame.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1"))
    blocks = F.ceil(F.col("_n") / F.lit(rows))
    # Never broadcast: Spark sizes a frame before its explode, and one of 10 MB can be hundreds on the driver.
    split = frame.hint("merge").join(sizes, group).withColumn("_blocks", blocks).withColumn(
        "_own", F.pmod(F.xxhash64(item), F.col("_blocks")))
    split = split.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return split.select(
        *frame.columns, F.least("_own", "_other").alias("block_a"), F.greatest("_own", "_other").alias("block_b"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"))
