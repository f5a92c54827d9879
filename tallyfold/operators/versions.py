"""Tables in versions: each holds the rows of the invoices it replaces, readers see the newest of each.

A store is a folder with one folder per table, laid out by version and by range of ids, and a list of
the invoices that each version replaces. That list is written last, so a version counts only when all
its tables are there; a run that failed is repeated under the same number. A change of some invoices
therefore reads and writes their ranges only, whatever the size of the tables.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import attach

KEY = "invoice_id"
_REPLACED, _LAYOUT = "_replaced", "_layout"
# Folders of a table, about; doublings of a range that are tried for it.
FOLDERS, DOUBLINGS = 256, 40


class Versions:
    """Tables of invoices (a column ``invoice_id`` each) below ``folder``; ``span`` ids make a range, or more if laid out so."""

    def __init__(self, spark: SparkSession, folder: str, span: int = 1_000_000):
        self.spark, self.folder, self.span = spark, folder, span
        self._doubled = self._stored_layout()

    def _stored_layout(self) -> int:
        """How often the span was doubled for this store; not at all before it is laid out."""
        try:
            found = self.spark.read.schema("doubled int").parquet(f"{self.folder}/{_LAYOUT}").first()
        except AnalysisException:
            found = None
        return found.doubled if found else 0

    def lay_out(self, invoices: DataFrame) -> None:
        """Doubles the span of a new store until ``invoices`` are in at most about ``FOLDERS`` ranges."""
        narrow = F.floor(F.col(KEY) / F.lit(self.span)).cast("long")
        ranges = invoices.select(narrow.alias("r")).distinct()
        counts = ranges.agg(*[F.approx_count_distinct(F.shiftright("r", k)) for k in range(DOUBLINGS)]).first()
        self._doubled = next((k for k, n in enumerate(counts) if n <= FOLDERS), DOUBLINGS)
        self.spark.range(1).select(F.lit(self._doubled).alias("doubled")).write.mode("overwrite").parquet(f"{self.folder}/{_LAYOUT}")

    def _range(self):
        return F.floor(F.col(KEY) / F.lit(self.span << self._doubled)).cast("long")

    def write(self, table: str, frame: DataFrame, version: int) -> DataFrame:
        """A table's rows of a version, as they stand there; they count from its commit on."""
        path = f"{self.folder}/{table}/_version={version}"
        frame.withColumn("_range", self._range()).hint("rebalance", "_range").write.mode("overwrite").partitionBy("_range").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def commit(self, replaced: DataFrame, version: int) -> None:
        """Lets a version count for the invoices it replaces. The first one, 0, replaces none."""
        replaced.select(KEY).distinct().withColumn("_version", F.lit(version)).write.mode("overwrite").parquet(
            f"{self.folder}/{_REPLACED}/{version:08d}")

    def _replaced(self) -> DataFrame:
        return self.spark.read.schema(f"{KEY} long, _version int").parquet(f"{self.folder}/{_REPLACED}/*")

    def ranges(self, of: DataFrame) -> list:
        """The ranges that the invoices of ``of`` are in: at most as many as the tables have."""
        return sorted(r[0] for r in of.select(self._range()).distinct().collect() if r[0] is not None)

    def rows(self, table: str, of: DataFrame = None) -> DataFrame:
        """All versions' rows, with ``_version``; with ``of`` only those of its invoices, and files of other ranges are not opened."""
        # The base path makes the version a column.
        path = f"{self.folder}/{table}"
        rows = self.spark.read.option("basePath", path).parquet(path)
        if of is not None:
            rows = rows.where(F.col("_range").isin(self.ranges(of))).join(of.select(KEY).distinct(), KEY, "left_semi")
        return rows.drop("_range")

    def newest(self, table: str, of: DataFrame = None) -> DataFrame:
        """Rows of every invoice's newest version, with ``_version``; of the invoices of ``of`` only.

        A version without a commit is nobody's newest.
        """
        latest = self._replaced().groupBy(KEY).agg(F.max("_version").alias("_latest"))
        if of is not None:
            latest = latest.join(of.select(KEY).distinct(), KEY, "left_semi")
        found = attach(self.rows(table, of), latest, [KEY])
        return found.where(F.col("_version") == F.coalesce("_latest", F.lit(0))).drop("_latest")
