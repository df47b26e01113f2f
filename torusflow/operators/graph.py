"""Connected components of any graph of ids, by stars that shrink over edges written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import forgotten, stepped


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct()


def _hung(pairs: DataFrame, both_ways: bool) -> DataFrame:
    """Every neighbour of a node, itself among them, hung under the least: all those above the node, or all below it."""
    near = pairs.select(F.col("high").alias("n"), F.col("low").alias("m"))
    if both_ways:
        near = near.unionByName(pairs.select(F.col("low").alias("n"), F.col("high").alias("m")))
    least = near.groupBy("n").agg(F.min("m").alias("top")).select("n", F.least("n", "top").alias("top"))
    moved = near.where("m > n") if both_ways else near
    # A step's size on disk says little about its rows, so it must not decide for a broadcast.
    out = moved.join(least.hint("merge"), "n").select(F.col("m").alias("a"), F.col("top").alias("b"))
    return out if both_ways else out.unionByName(least.select(F.col("n").alias("a"), F.col("top").alias("b")))


def _settled(pairs: DataFrame) -> bool:
    """Whether every node hangs under one node alone, and that under none."""
    ends = pairs.select(F.col("high").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("low").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (a, b): the least id that it is connected to.

    ids may be of any type that has an order. Each round hangs what lies above a node under the
    node's least neighbour, then what lies below; paths halve, so rounds grow with the
    logarithm of the longest. Loops and repeated edges are allowed; a null end drops the edge.
    """
    spark = edges.sparkSession
    alone = edges.where("a = b").select(F.col("a").alias("id")).distinct()
    pairs, path = stepped(_directed(edges.where("a is not null and b is not null")), "edges")
    while not _settled(pairs):
        large, middle = stepped(_directed(_hung(pairs, True)), "edges")
        forgotten(spark, path)
        pairs, path = stepped(_directed(_hung(large, False)), "edges")
        forgotten(spark, middle)
    found = pairs.select(F.col("high").alias("id"), F.col("low").alias("root"))
    roots = found.select(F.col("root").alias("id")).distinct()
    found = found.unionByName(roots.select("id", F.col("id").alias("root")))
    return found.unionByName(alone.join(found.hint("merge"), "id", "left_anti").select("id", F.col("id").alias("root")))
