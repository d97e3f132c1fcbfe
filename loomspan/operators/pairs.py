"""Pairs within groups, cut into tiles so that a large group is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a group that make a block. A tile compares two blocks.
BLOCK = 1024


def _blocks(df: DataFrame, on: list[str], block: int) -> DataFrame:
    """``on`` and ``n``: how many blocks each group of more than one has. Few groups have, so that this is small."""
    return df.groupBy(*on).agg(F.ceil(F.count("*") / block).alias("n")).where("n > 1")


def _block(item: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(item), n)


def _upto(first: Column, last: Column) -> Column:
    """Numbers from ``first`` to ``last``, none if there are none."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def tiled_join(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, block: int = BLOCK) -> DataFrame:
    """All pairs of ``left(on, a)`` and ``right(on, b)`` with the same ``on``.

    A group of x blocks on one side and y on the other becomes x * y tiles, each a key of its own; an item goes to the
    tiles of its block. Groups of one block are joined as they are.
    """
    one = F.lit(1).cast("long")
    x, y = _blocks(left, on, block).withColumnRenamed("n", "__x"), _blocks(right, on, block).withColumnRenamed("n", "__y")
    sized = lambda df: df.join(x, on, "left").join(y, on, "left").withColumns({"__x": F.coalesce("__x", one), "__y": F.coalesce("__y", one)})
    each = lambda n: F.explode(_upto(F.lit(0).cast("long"), F.col(n) - 1))
    l = sized(left).select(*on, a, _block(F.col(a), F.col("__x")).alias("__i"), each("__y").alias("__j"))  # noqa: E741
    r = sized(right).select(*on, b, _block(F.col(b), F.col("__y")).alias("__j"), each("__x").alias("__i"))
    return l.join(r, [*on, "__i", "__j"]).select(*on, a, b)


def pairs_of(members: DataFrame, on: list[str], item: str, block: int = BLOCK) -> DataFrame:
    """``(on, x, y)``, x < y: each pair of distinct items of a group once, from ``members(on, item)`` without repeats.

    A group of n blocks becomes n * (n + 1) / 2 tiles, each of two blocks (or one with itself).
    """
    sized = members.join(_blocks(members, on, block).withColumnRenamed("n", "__n"), on, "left").withColumn("__n", F.coalesce("__n", F.lit(1).cast("long")))
    own = sized.select(*on, F.col(item).alias("__item"), _block(F.col(item), F.col("__n")).alias("__b"), "__n")
    first = own.select(*on, F.col("__item").alias("x"), F.col("__b").alias("__p"), F.explode(_upto(F.col("__b"), F.col("__n") - 1)).alias("__q"))
    second = own.select(*on, F.col("__item").alias("y"), F.explode(_upto(F.lit(0).cast("long"), F.col("__b"))).alias("__p"), F.col("__b").alias("__q"))
    met = first.join(second, [*on, "__p", "__q"]).where("__p < __q or x < y")
    return met.select(*on, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
