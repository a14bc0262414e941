"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, grouped, release

#: Edges that a partition of a round's result holds, at least.
EDGES = 50_000


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (integers, either direction, repeats allowed) to ``node, component``: the smallest node reachable.

    Every node of an edge has a row. Each round keeps at most as many edges as before; what reaches the driver is their number
    and whether all are stars. A hub is one hot key of a join that adaptive execution can split (see ``grouped``);
    minima combine before the shuffle.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    alone = edges.filter("a = b").select(F.col("a").alias("node"))
    while (left := _unfinished(now)) is not None:
        # Large star: every larger neighbour of u goes to the smallest node around u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = grouped(both, ["u"], F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # Small star: the smaller neighbours of u, and u, go to the smallest of them.
        least = grouped(large, ["u"], F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, now = now, checkpointed(small.distinct().coalesce(max(1, left // EDGES)))
        discard(before)
    release(edges.sparkSession)
    roots = now.select(F.col("v").alias("node")).unionByName(alone).distinct()
    inner = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.unionByName(roots.join(inner, "node", "left_anti").select("node", F.col("node").alias("component")))


def _unfinished(edges: DataFrame) -> int | None:
    """The number of edges, or None once they are stars: nothing has two parents or a parent with one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = node.agg(F.sum("up").alias("n"), F.max((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).alias("more")).first()
    return row["n"] if row["more"] else None
