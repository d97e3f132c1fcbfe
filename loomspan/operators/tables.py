"""Tables written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: list[str] = []
_DELETED_AT_END: set[str] = set()
#: The folder of the innermost ``passing`` block of this thread.
_PASSING: ContextVar[str | None] = ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a folder of our own only where that is unset and the master is local (tests)."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="loomspan-"))
    return _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder, which goes when the driver ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/loomspan/{context.applicationId}"
    if folder not in _DELETED_AT_END:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _DELETED_AT_END.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path with all that is in it, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _table_path(spark: SparkSession, name: str) -> str:
    within = _PASSING.get()
    return f"{within}/{name}-{uuid.uuid4().hex}" if within else new_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage and survives the loss of executors. It stays until the driver, or a ``passing`` block around, ends."""
    path = _table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` writes in the block go at its end; what is made from them must be written elsewhere by then."""
    folder = new_path(spark, "passing")
    token = _PASSING.set(folder)
    try:
        yield
    finally:
        _PASSING.reset(token)
        removed(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a written table; the tables written on the way to it go."""
    path = _table_path(spark, name)
    with passing(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 5000) -> DataFrame:
    """``df`` dealt over tasks of at most so many rows, for work that is dear by row: a table of short rows is few splits, whatever is done with each."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


# What a task reads at most, whatever the size of the table. A row of a key may become a hundred bytes in a
# sort or a hash table, and several pairs, so that these sizes, and not the table's, decide about a task's memory.
BOUNDS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 4 << 20, "spark.sql.files.maxPartitionBytes": 8 << 20}
PARTS, _PARTS_KEY = 2000, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_GIVEN = "_loomspan_given"


def bounded(spark: SparkSession) -> None:
    """Sets the session so that tasks are many and small: adaptive execution puts the ``PARTS`` parts of a shuffle together up to a size that doesn't grow with the input."""
    given = {k: spark.conf.get(k, None) for k in (*BOUNDS, _PARTS_KEY)}
    if not hasattr(spark, _GIVEN):
        setattr(spark, _GIVEN, given)
    for key, most in BOUNDS.items():
        spark.conf.set(key, str(min(most, _bytes(spark, given[key]))))
    spark.conf.set(_PARTS_KEY, str(max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def unbounded(spark: SparkSession) -> None:
    """Sets back what ``bounded`` has set."""
    for key, value in getattr(spark, _GIVEN, {}).items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    if hasattr(spark, _GIVEN):
        delattr(spark, _GIVEN)


def _bytes(spark: SparkSession, size: str | None) -> int:
    """A size as Spark writes it, in bytes."""
    return 1 << 62 if size is None else int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size))


class Scratch:
    """Written tables that go at the end of a ``with`` block, for streams, which would else leave some with every batch."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, new_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        removed(self.spark, self.path)


def numbered(df: DataFrame, keys: list[str], order: list, to: str = "place") -> DataFrame:
    """``df`` with each row's place within its key, from 0, in an order without ties.

    The table is sorted over all tasks by ranges of key and order; a place is the number of the key's rows in ranges
    before plus the place within the range. So a key of any size is spread over as many tasks as it fills.
    """
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    own = [*keys, "__part"]
    counts = ranged.groupBy(*own).agg(F.count("*").alias("__n"))
    # As many rows as keys and, for keys in several ranges, ranges.
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select(*own, F.coalesce("__before", F.lit(0)).alias("__before"))
    within = ranged.withColumn("__r", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    same = [within[c].eqNullSafe(before[c]) for c in own]
    return within.join(before, same).select(*(within[c] for c in df.columns), (F.col("__before") + F.col("__r") - 1).alias(to))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for clusters on which it is not installed; once a context."""
    context = spark.sparkContext
    if getattr(context, "_loomspan_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="loomspan-")) / "loomspan.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(to))
    context._loomspan_shipped = True
