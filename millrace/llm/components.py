"""Connected components of a link table by alternating large and small stars, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, stage_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u, v).  large: neighbours above a node move to its least neighbour; small: the node and
    its neighbours below move to the least of them.  The least comes from an aggregate (combined before the shuffle), so a
    hub's neighbours are never gathered; the join that hands it out is split by AQE where a hub is hot."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for each node that occurs in ``edges`` (u, v); root: the least node reachable.  Nodes must be ordered.

    Rounds go on until the edges stay the same, about the logarithm of the longest chain.
    """
    now = stage_table(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        following = stage_table(_stars(stage := stage_table(_stars(now, True), "large"), False), "edges")
        drop_table(stage)
        drop_table(now)
        now = following
    else:
        raise RuntimeError(f"components are not found after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
