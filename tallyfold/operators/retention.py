"""Taking expired rows out of a stored table: only the touched partitions are rewritten, and it is audited."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def apply_retention(spark: SparkSession, table: str, partition: str, key: str, expired: Column, audit: str, run: str) -> DataFrame:
    """Removes expired rows from the Parquet table at ``table``, laid out by ``partition``; returns the audit rows.

    The audit of the run is written first and names what goes; what it names is then taken out of the
    partitions it names, one after the other in one job. A run that failed is repeated under the same
    name: its audit stands, and taking out what is gone already changes nothing. Partitions without
    expired rows keep their files; a partition of which nothing is left goes.
    """
    path = f"{audit}/run={run}"
    files = spark._jvm.org.apache.hadoop.fs
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    conf = spark._jsc.hadoopConfiguration()

    def system(at):
        where = files.Path(at)
        return where.getFileSystem(conf), where

    fs, done = system(f"{path}/_SUCCESS")
    if not fs.exists(done):
        rows = spark.read.parquet(table).where(expired).select(
            F.col(partition).alias("partition"), F.col(key).cast("string").alias("resource_id"), F.lit("expired").alias("action"))
        rows.write.mode("overwrite").parquet(path)
    gone = spark.read.schema(f"partition {dict(spark.read.parquet(table).dtypes)[partition]}, resource_id string, action string").parquet(path)
    touched = [r[0] for r in gone.select("partition").distinct().collect()]
    if touched:
        old = spark.read.parquet(table).where(F.col(partition).isin([x for x in touched if x is not None])
                                              | (F.col(partition).isNull() if None in touched else F.lit(False)))
        ids = gone.select("partition", F.col("resource_id").alias("_id")).distinct()
        kept = old.join(ids, F.col(partition).eqNullSafe(F.col("partition")) & F.col(key).cast("string").eqNullSafe(F.col("_id")), "left_anti")
        left = {r[0] for r in kept.select(partition).distinct().collect()}
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
        for value in touched:
            if value not in left:
                text = None if value is None else str(value)
                fs, folder = system(f"{table}/{names.getPartitionPathString(partition, text)}")
                fs.delete(folder, True)
    return gone
