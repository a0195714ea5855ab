"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kerbline.runtime import drop, materialize


def _written(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a hash that does not depend on order, observed as they are written."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    table = materialize(edges.observe(seen, F.count("*").alias("n"), checksum.alias("h")), "cc", rows)
    return table, (seen.get["n"], seen.get["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` → ``(node, root)`` for every node with an edge; root is the component's least node.

    The edge list never grows beyond its first size by more than the node count, a hub's neighbours are pre-aggregated
    by ``min`` before the shuffle, and every round is written to the shared folder. Self-loops and nulls give no row.
    """
    now, before = _written(edges.select("u", "v").where("u <> v").distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        after, state = _written(_small_star(_large_star(now)), before[0])
        drop(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
