"""A log of updates that arrive in batches, folded into a base so that readers open few files."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class UpdateLog:
    """Batches of updates below ``folder``, and bases that hold all batches up to a number.

    ``merge`` turns rows of any batches into the rows that count; merging merged rows with later ones
    must give the same. Every ``every`` batches the tail is folded into a new base. A base counts once
    it is whole, so a fold that failed is repeated; a batch that is run again replaces its own rows,
    or is in the base already, where it changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], every: int = 16):
        self.spark, self.folder, self.merge, self.every = spark, folder, merge, every

    def _numbers(self, kind: str) -> list:
        """Numbers of the whole batches or bases, rising."""
        files = self.spark._jvm.org.apache.hadoop.fs
        path = files.Path(f"{self.folder}/{kind}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [s.getPath() for s in system.listStatus(path)]
        return sorted(int(p.getName()) for p in names if system.exists(files.Path(p, "_SUCCESS")))

    def paths(self) -> list:
        """What a reader opens: the newest base and the batches after it."""
        base = self._numbers("base")[-1:]
        tail = [n for n in self._numbers("batch") if not base or n > base[0]]
        return [f"{self.folder}/base/{n}" for n in base] + [f"{self.folder}/batch/{n}" for n in tail]

    def append(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch/{number}")
        if len(self.paths()) > self.every:
            self.fold()

    def fold(self) -> None:
        """Writes a base of all there is; what it replaces goes once it is whole."""
        batches, bases = self._numbers("batch"), self._numbers("base")
        if not batches or (bases and bases[-1] >= batches[-1]):
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/base/{batches[-1]}")
        files = self.spark._jvm.org.apache.hadoop.fs
        system = files.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        # The newest replaced base stays for readers that opened it; older ones and their batches go.
        for kind, gone in (("base", bases[:-1]), ("batch", [n for n in batches if bases and n <= bases[-1]])):
            for n in gone:
                system.delete(files.Path(f"{self.folder}/{kind}/{n}"), True)

    def read(self) -> DataFrame:
        return self.merge(self.spark.read.parquet(*self.paths()))
