"""From raw street edges to the segment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geometry as g
from kerbline.functions.scalar import road_class
from kerbline.operators.relational import keep_first, number_rows, surrogate_ids


def node_key(vertex: Column) -> Column:
    """What makes two line ends one node: both coordinates, rounded half to even to 6 decimals."""
    return F.struct(F.bround(vertex["x"], 6).alias("x"), F.bround(vertex["y"], 6).alias("y"))


def street_segments(raw: DataFrame, boundary: Column | None = None) -> DataFrame:
    """``(id, from, to, highway, coords)`` from ``raw(ord, highway, coords)``, in degrees.

    Node ids come from end points rounded to 6 decimals in order of appearance; of streets with the same two ends the first
    stays; unknown classes go; with a boundary, only lines wholly inside stay. Ids are dense, in order of ``ord``.
    """
    d = raw.where(F.size("coords") > 0).withColumns({"a": node_key(g.first_vertex(F.col("coords"))), "b": node_key(g.last_vertex(F.col("coords")))})
    nodes = surrogate_ids(d.select("a", "b", "ord"), "a", "b", ["ord"])
    d = d.join(nodes.select(F.col("key").alias("a"), F.col("node").alias("from")), "a").join(nodes.select(F.col("key").alias("b"), F.col("node").alias("to")), "b")
    d = d.withColumns({"lo": F.least("from", "to"), "hi": F.greatest("from", "to")})
    d = keep_first(d, ["lo", "hi"], ["ord"]).withColumn("highway", road_class(F.col("highway"))).where("highway is not null")
    if boundary is not None:
        d = d.where(g.line_within(F.col("coords"), boundary))
    return number_rows(d, ["ord"], "id").select(F.col("id").cast("long").alias("id"), "from", "to", "highway", "coords")
