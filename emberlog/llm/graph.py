"""Distributed connected components: alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node that can be reached.

    Nodes are longs or strings. Direction, repeated edges and loops don't matter; edges with a null end are
    left out. A node with only a loop is its own component. No edges give no rows. The minima of a step are
    written out before they meet the edges again, so that the join's exchanges can be split at hubs.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    ends = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    loops = ends.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    cur = ends.filter("u > v")
    old, before = [], None
    state = _state(cur)
    while state != before and state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = materialize(
            both.join(least, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "below")
        small = large.join(below, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(least, large, below, *old)
        cur, old = new, [new]
        before, state = state, _state(new)
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(heads).unionByName(loops.join(stars.select("node"), "node", "left_anti")).distinct()
