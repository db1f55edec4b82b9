"""Connected components by alternating large-star and small-star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each u: summed up before the shuffle, so a node with many neighbours is no heavier than another."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) bigint, in any direction. Returns (node, component): every node that has an edge, and the smallest node it reaches."""
    own = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(own)
    while state[0]:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        # Kept at each step: the plan stays short, and a lost executor costs one step at most.
        new = keep(small.distinct(), "edges")
        before, state = state, _state(new)
        forget(own)
        own = new
        if state == before:
            break
    # Now every node but the smallest of its component has one edge, to that smallest one.
    return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
