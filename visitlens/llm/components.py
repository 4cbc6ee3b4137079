"""Connected components by alternating large and small stars; every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the least of its neighbourhood.  Small star: every smaller one."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        met = near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        return met.where("u <> v").distinct()
    near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    met = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the least node of the component."""
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        after = scratch.save(_star(_star(now, True), False), "edges")
        scratch.drop(now)
        now = after
        # done when all are stars: a leaf has one link and is no centre
        ends = now.select("u", F.lit(1).alias("out"), F.lit(0).alias("to")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("to")))
        if not ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("to").alias("to")).where("out + to > 1 AND out > 0").limit(1).count():
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
