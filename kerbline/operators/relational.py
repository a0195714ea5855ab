"""Relational steps with an explicit row order, where the plain ones would depend on the input's."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.gridjoin import keep_first
from kerbline.runtime import materialize

__all__ = [
    "complete", "degrees", "drop_repeated_names", "first_column", "fused_edges", "keep_first", "left_chain", "number_rows",
    "pad_columns", "quantiles", "surrogate_ids", "two_sided",
]


def number_rows(df: DataFrame, order: Sequence[str], name: str = "n", start: int = 0) -> DataFrame:
    """Dense numbers in order. Parts get their offsets from counts, so rows stay spread over tasks."""
    parts = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__kerb_part", F.spark_partition_id())
    local = Window.partitionBy("__kerb_part").orderBy(*order)
    # Written once: a second evaluation could draw other range bounds.
    ranked = materialize(parts.withColumn("__kerb_local", F.row_number().over(local)), "numbered")
    sizes = ranked.groupBy("__kerb_part").agg(F.max("__kerb_local").alias("__kerb_size"))
    before = F.sum("__kerb_size").over(Window.orderBy("__kerb_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__kerb_part", F.coalesce(before, F.lit(0)).alias("__kerb_before"))
    out = ranked.join(offsets, "__kerb_part").withColumn(name, F.col("__kerb_before") + F.col("__kerb_local") - 1 + start)
    return out.drop("__kerb_part", "__kerb_local", "__kerb_before")


def surrogate_ids(df: DataFrame, first: str, second: str, order: Sequence[str]) -> DataFrame:
    """``(key, node)``: ids from 1 in order of first appearance, all keys of ``first`` before those only in ``second``."""
    keys = df.select(F.col(first).alias("key"), F.lit(0).alias("side"), *order).unionByName(
        df.select(F.col(second).alias("key"), F.lit(1).alias("side"), *order)
    )
    least = keys.groupBy("key").agg(F.min(F.struct("side", *order)).alias("o"))
    return number_rows(least.select("key", "o.*"), ["side", *order, "key"], "node", 1).select("key", "node")


def quantiles(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """One row ``(q array<double>)``: interpolated quantiles of a column, null without values.

    Exact: values are counted, cut into ranges, and each range gets its offset from counts, so no task holds all of them.
    """
    counts = df.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    local = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = materialize(parts.withColumn("before", F.coalesce(F.sum("n").over(local), F.lit(0))), "quantiles")
    sizes = ranked.groupBy("part").agg(F.sum("n").alias("size"))
    base = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", base.alias("base"), F.sum("size").over(Window.partitionBy()).alias("total"))
    at = ranked.join(offsets, "part").withColumn("first", F.col("base") + F.col("before"))
    holds = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("v")))
    place = [F.lit(float(q)) * (F.col("total") - 1) for q in qs]
    ends = at.agg(*[c for i, p in enumerate(place) for c in (holds(F.floor(p)).alias(f"lo{i}"), holds(F.ceil(p)).alias(f"hi{i}"))], F.max("total").alias("total"))
    return ends.select(F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]).alias("q"))


def left_chain(base: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """All tables left-joined to ``base`` on one key; a column name that came before is left out of later tables."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, "left")

    return reduce(add, tables, base)


def two_sided(edges: DataFrame, values: DataFrame, u: str, v: str, node: str, value: str, name: str) -> DataFrame:
    """The mean of a node value over both ends of each edge; a node without one counts as 0."""
    a = values.select(F.col(node).alias(u), F.col(value).alias("__kerb_a"))
    b = values.select(F.col(node).alias(v), F.col(value).alias("__kerb_b"))
    both = edges.join(a, u, "left").join(b, v, "left")
    mean = (F.coalesce("__kerb_a", F.lit(0)) + F.coalesce("__kerb_b", F.lit(0))) / 2
    return both.withColumn(name, mean).drop("__kerb_a", "__kerb_b")


def fused_edges(edges: DataFrame, u: str, v: str, weight: str, floor: float = 1e-6) -> DataFrame:
    """Undirected simple edges ``(u, v, w)``: of parallel ones the least weight, at least ``floor``; no self-loops dropped."""
    ends = [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]
    return edges.groupBy(*ends).agg(F.greatest(F.min(weight), F.lit(floor)).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)`` of distinct undirected edges; a self-loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def first_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column, by exact name."""
    return next((c for c in candidates if c in set(columns)), None)


def drop_repeated_names(columns: Sequence[str]) -> list[int]:
    """Positions of the first column of each name."""
    return [i for i, c in enumerate(columns) if c not in columns[:i]]


def pad_columns(df: DataFrame, wanted: Sequence[str], value: float = 0.0) -> DataFrame:
    """The wanted columns in their order; absent ones and missing or non-finite values become ``value``."""

    def pick(c: str) -> Column:
        if c not in df.columns:
            return F.lit(value).alias(c)
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(value)).otherwise(x).alias(c)

    return df.select(*[pick(c) for c in wanted])


def complete(base: DataFrame, features: DataFrame, key: str, defaults: dict[str, float]) -> DataFrame:
    """Every row of ``base`` with its features, and the default of each where there are none."""
    joined = base.join(features, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
