"""Connected components by alternating large-star and small-star.

Every round is two joins of the edges with each node's smallest neighbour; a
hub's edges spread over tasks because both sides of the join come from written
tables and Spark splits large partitions. Edges never leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import dropped, saved


def large_star(edges: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Link each node's larger neighbours to the smallest node around it; also
    the written table that this reads."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least", 2 * rows)
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def small_star(edges: DataFrame, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Link each node and its smaller neighbours to the smallest of them; also
    the written tables that this reads."""
    down = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-down", rows)
    least = saved(down.groupBy("u").agg(F.min("v").alias("m")), "star-least", rows)
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct(), [down, least]


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``edges`` (``u, v``: whole numbers);
    a component is named by its smallest node. Loops and repeats do no harm;
    null ends are left out; no edges give no rows.
    """
    now = saved(edges.where("u != v"), "star-edges")
    before = None
    while (at := _sum(now)) != before:
        before = at
        large, read = large_star(now, at[0])
        small, more = small_star(large, at[0])
        last, now = now, saved(small, "star-edges", 2 * at[0])
        dropped(last, read, *more)
    # converged: every edge goes from a node to its component's smallest
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = saved(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components", 2 * at[0])
    dropped(now)
    return out
