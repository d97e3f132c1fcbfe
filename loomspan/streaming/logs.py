"""Tables that a stream keeps: a snapshot and a bounded log of batches behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ChangeLog:
    """Rows of keys, of which those of the newest ``version`` count, in a folder.

    Each batch is a folder ``batch=n``; one that runs again replaces its own. After every ``every`` batches the newest
    rows of all keys are written as ``snapshot=n``, and what it holds goes once it is complete. So a reader reads one
    snapshot and fewer than ``every`` batches, however many there have been. The rows of a key are a set: all of its newest
    version, none of an older one, whatever the order in which batches come.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...], version: str, every: int = 20, form: str = "parquet"):
        self.form = form
        self.spark, self.folder, self.keys, self.version, self.every = spark, folder.rstrip("/"), keys, version, every
        self.schema = StructType.fromDDL(schema)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._top = path(self.folder)
        self._path = lambda name: path(self._top, name)
        self._files = self._top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> tuple[list[int], list[int]]:
        """Numbers of the complete snapshots and of the batches that are there."""
        if not self._files.exists(self._top):
            return [], []
        names = [s.getPath().getName() for s in self._files.listStatus(self._top)]
        done = lambda kind: sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=") and self._files.exists(self._path(f"{n}/_SUCCESS")))
        return done("snapshot"), done("batch")

    def write(self, rows: DataFrame, number: int) -> None:
        """Adds the rows of a batch, and compacts where it is due."""
        rows.select(*self.schema.names).write.mode("overwrite").format(self.form).save(f"{self.folder}/batch={number}")
        snapshots, batches = self.parts()
        last = max(snapshots, default=-1)
        if number > last and len([b for b in batches if b > last]) >= self.every:
            self.compact(number)

    def compact(self, number: int) -> None:
        """Writes what is there up to a batch as a snapshot, then removes what it holds."""
        self.replace(self.read(before=number + 1), number)

    def replace(self, rows: DataFrame, number: int) -> None:
        """Writes rows, the newest of all keys, as a snapshot, then removes what is older."""
        rows.select(*self.schema.names).write.mode("overwrite").format(self.form).save(f"{self.folder}/snapshot={number}")
        snapshots, batches = self.parts()
        gone = [f"snapshot={n}" for n in snapshots if n < number] + [f"batch={n}" for n in batches if n <= number]
        for name in gone:
            self._files.delete(self._path(name), True)

    def sources(self, before: int | None = None) -> list[str]:
        """The folders that a reader reads: the last snapshot and the batches after it."""
        snapshots, batches = self.parts()
        fits = lambda n: before is None or n < before
        last = max((n for n in snapshots if fits(n)), default=-1)
        return [f"{self.folder}/snapshot={last}"] * (last >= 0) + [f"{self.folder}/batch={n}" for n in batches if n > last and fits(n)]

    def read(self, before: int | None = None) -> DataFrame:
        """The newest rows of each key, of all batches or of those before one."""
        sources = self.sources(before)
        if not sources:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).format(self.form).load(sources)
        if len(sources) == 1 and "/snapshot=" in sources[0][len(self.folder) :]:
            return rows
        newest = rows.groupBy(*self.keys).agg(F.max(self.version).alias(self.version))
        return rows.join(newest, [*self.keys, self.version], "left_semi").distinct()
