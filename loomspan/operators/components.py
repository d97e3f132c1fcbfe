"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.tables import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``: the smallest node reachable, for every node of an edge.

    Alternates the large-star and small-star steps, which turn each component into a star around its smallest node in
    a number of rounds that grows with the logarithm of its size. Every round is one grouping per step over edges
    keyed by node, written to the shared folder; only a fingerprint of the edges reaches the driver. A hub with very
    many neighbours is a window over its edges, which spills; nothing is collected into an array. Edges with a null
    end are ignored, loops keep their node as its own component, and an empty table gives an empty one.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = clean.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edge = written(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        edge = written(_star(_star(edge, large=True), large=False), "cc")
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    star = edge.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(star, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _star(edge: DataFrame, large: bool) -> DataFrame:
    """Large: links every larger neighbour of a node to its smallest neighbour (itself counted). Small: links the smaller ones."""
    both = edge.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*") if large else edge
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        return joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
