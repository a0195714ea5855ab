"""The driver's tables under the names of the street data model, in integer arithmetic that any engine repeats exactly."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the surrogate raster, its cell and its affine (a, c, e, f).
SIDE, CELL = 128, 80
AFFINE = (80.0, 0.0, -80.0, 10240.0)
#: The land-cover codes in order of code, and the three groups of them.
COVER = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)
GREEN, BLUE, IMPERVIOUS = (10, 20, 30, 90, 95, 100), (80,), (50,)
EVENT_TYPES = ("click", "error", "purchase", "scroll", "signup", "view")

#: The same tables as SQL.
CTES = {
    "segments": """SELECT o_orderkey AS id, (o_orderkey * 7919) % 10007 AS x0, (o_orderkey * 104729) % 10007 AS y0,
        (o_orderkey * 7919) % 10007 + (o_orderkey * 31) % 201 - 100 AS x1, (o_orderkey * 104729) % 10007 + (o_orderkey * 17) % 161 - 80 AS y1,
        o_custkey AS a, o_custkey + 1 + o_orderkey % 7 AS b, o_orderpriority AS highway FROM orders""",
    "pois": """SELECT event_id, (event_id * 6007) % 10007 AS px, (event_id * 15485863) % 10007 AS py, event_type AS cat_l1,
        json_extract_string(props, '$.k') AS cat_l2 FROM events""",
    "buildings": """SELECT p_partkey AS rid, (p_partkey * 3571) % 10007 AS px, (p_partkey * 2741) % 10007 AS py, p_retailprice AS area,
        p_size AS height, p_brand AS brand FROM part""",
    "cells": """SELECT CAST(l_partkey % 128 AS INTEGER) AS "row", CAST(l_orderkey % 128 AS INTEGER) AS col, sum(l_quantity) AS value,
        avg(l_extendedprice) / 977 AS dem, avg(l_discount) AS disc FROM lineitem GROUP BY 1, 2""",
    "cover": """SELECT r.i AS "row", c.i AS col, [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100][(r.i * 31 + c.i * 17) % 11 + 1] AS value
        FROM (SELECT unnest(range(128)) AS i) r, (SELECT unnest(range(128)) AS i) c""",
    "edges": """SELECT u, v, greatest(min(w), 1e-6) AS w FROM (SELECT least(a, b) AS u, greatest(a, b) AS v,
        sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE)) AS w FROM segments) GROUP BY u, v""",
    "nodes": """SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node""",
}


class Tables:
    """Tables of one folder by name, the driver's and the surrogates."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def segments(self) -> DataFrame:
        k = F.col("o_orderkey")
        d = self.orders.select(
            k.alias("id"), ((k * 7919) % 10007).alias("x0"), ((k * 104729) % 10007).alias("y0"), F.col("o_custkey").alias("a"),
            (F.col("o_custkey") + 1 + k % 7).alias("b"), F.col("o_orderpriority").alias("highway"),
        )
        end = {"x1": F.col("x0") + (F.col("id") * 31) % 201 - 100, "y1": F.col("y0") + (F.col("id") * 17) % 161 - 80}
        return d.withColumns(end)

    @cached_property
    def pois(self) -> DataFrame:
        k = F.col("event_id")
        return self.events.select(
            "event_id", ((k * 6007) % 10007).alias("px"), ((k * 15485863) % 10007).alias("py"), F.col("event_type").alias("cat_l1"),
            F.get_json_object("props", "$.k").alias("cat_l2"),
        )

    @cached_property
    def buildings(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.part.select(
            k.alias("rid"), ((k * 3571) % 10007).alias("px"), ((k * 2741) % 10007).alias("py"), F.col("p_retailprice").alias("area"),
            F.col("p_size").alias("height"), F.col("p_brand").alias("brand"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        at = [(F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_orderkey") % SIDE).cast("int").alias("col")]
        return self.lineitem.groupBy(*at).agg(
            F.sum("l_quantity").alias("value"), (F.avg("l_extendedprice") / 977).alias("dem"), F.avg("l_discount").alias("disc")
        )

    @property
    def dem(self) -> DataFrame:
        return self.cells.select("row", "col", F.col("dem").alias("value"))

    @property
    def ndvi(self) -> DataFrame:
        return self.cells.select("row", "col", F.when((F.col("row") + F.col("col")) % 37 != 0, F.col("disc")).alias("value"))

    @cached_property
    def cover(self) -> DataFrame:
        codes = F.array(*map(F.lit, COVER))
        grid = self.spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).cast("int").alias("row"), (F.col("id") % SIDE).cast("int").alias("col"))
        return grid.withColumn("value", F.get(codes, ((F.col("row") * 31 + F.col("col") * 17) % 11).cast("int")))

    @cached_property
    def edges(self) -> DataFrame:
        from kerbline.functions.geometry import hypot
        from kerbline.operators.relational import fused_edges

        d = self.segments.withColumn("len", hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
        return fused_edges(d, "a", "b", "len")

    @property
    def nodes(self) -> DataFrame:
        from kerbline.operators.relational import degrees

        return degrees(self.edges)
