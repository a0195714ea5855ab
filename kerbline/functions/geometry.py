"""Geometry as Column expressions: polylines and rings are ``array<struct<x, y>>`` in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def first_vertex(coords: Column) -> Column:
    return F.get(coords, 0)


def last_vertex(coords: Column) -> Column:
    return F.try_element_at(coords, F.lit(-1))


def legs(coords: Column) -> Column:
    """Consecutive vertex pairs ``array<struct<a, b, d>>`` with their lengths."""
    n = F.greatest(F.size(coords) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(coords, F.lit(1), n).alias("a"), F.slice(coords, F.lit(2), n).alias("b"))
    return F.transform(
        pairs,
        lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]).alias("d")),
    )


def length(coords: Column) -> Column:
    return F.aggregate(legs(coords), F.lit(0.0), lambda s, p: s + p["d"])


def chord(coords: Column) -> Column:
    a, b = first_vertex(coords), last_vertex(coords)
    return hypot(b["x"] - a["x"], b["y"] - a["y"])


def midpoint(coords: Column) -> Column:
    """The point half way along the polyline; the first vertex if it has no length."""
    half = length(coords) / 2
    start = F.struct(F.lit(0.0).alias("s"), first_vertex(coords)["x"].alias("x"), first_vertex(coords)["y"].alias("y"))

    def walk(acc: Column, p: Column) -> Column:
        here = (acc["s"] < half) & (acc["s"] + p["d"] >= half)
        t = (half - acc["s"]) / F.greatest(p["d"], F.lit(1e-300))
        return F.struct(
            (acc["s"] + p["d"]).alias("s"),
            F.when(here, p["a"]["x"] + t * (p["b"]["x"] - p["a"]["x"])).otherwise(acc["x"]).alias("x"),
            F.when(here, p["a"]["y"] + t * (p["b"]["y"] - p["a"]["y"])).otherwise(acc["y"]).alias("y"),
        )

    return F.aggregate(legs(coords), start, walk, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def straightness(len_: Column, chord_: Column) -> Column:
    return F.when(len_ > 1e-6, chord_ / len_).otherwise(F.lit(0.0))


def circuity(len_: Column, chord_: Column) -> Column:
    return F.when(chord_ > 1e-6, len_ / chord_).otherwise(F.lit(1.0))


def bearing_bin(dx: Column, dy: Column, width: float = 5.0) -> Column:
    """Undirected bearing in bins of ``width`` degrees over half a turn."""
    degrees = F.pmod(F.degrees(F.atan2(dy, dx)) + 360.0, F.lit(180.0))
    return F.least(F.greatest(F.floor(degrees / width), F.lit(0)), F.lit(int(180 / width) - 1)).cast("int")


def segment_distance2(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Squared distance of a point from a straight segment, which may have no length."""
    dx, dy = (x1 - x0).cast("double"), (y1 - y0).cast("double")
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / F.greatest(l2, F.lit(1e-300))))).otherwise(F.lit(0.0))
    ex, ey = x - (x0 + t * dx), y - (y0 + t * dy)
    return ex * ex + ey * ey


def polyline_distance2(x: Column, y: Column, coords: Column) -> Column:
    return F.array_min(F.transform(legs(coords), lambda p: segment_distance2(x, y, p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])))


def ring_area2(ring: Column) -> Column:
    """Twice the signed area of a closed ring."""
    return F.aggregate(legs(ring), F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]))


def polygon_area(rings: Column) -> Column:
    """Outer ring less holes."""
    return F.aggregate(
        F.transform(rings, lambda r, i: F.abs(ring_area2(r)) / 2 * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, a: s + a
    )


def polygon_perimeter(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, length), F.lit(0.0), lambda s, a: s + a)


def ring_centroid(ring: Column) -> Column:
    """Centroid of a ring with area, relative to its first vertex for accuracy; without area its first vertex."""
    o = first_vertex(ring)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, p: Column) -> Column:
        ax, ay, bx, by = p["a"]["x"] - o["x"], p["a"]["y"] - o["y"], p["b"]["x"] - o["x"], p["b"]["y"] - o["y"]
        c = ax * by - bx * ay
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (ax + bx) * c).alias("x"), (acc["y"] + (ay + by) * c).alias("y"))

    def done(acc: Column) -> Column:
        flat = F.abs(acc["a"]) < 1e-300
        part = lambda k: F.when(flat, o[k]).otherwise(o[k] + acc[k] / (3 * F.when(flat, 1.0).otherwise(acc["a"])))
        return F.struct(part("x").alias("x"), part("y").alias("y"))

    return F.aggregate(legs(ring), zero, add, done)


def compactness(area: Column, perimeter: Column) -> Column:
    ratio = F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(F.lit(0.0))
    return F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether the number of edges to the right of the point is odd."""
    crosses = F.filter(
        legs(ring),
        lambda p: ((p["a"]["y"] > y) != (p["b"]["y"] > y))
        & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / F.when(p["b"]["y"] == p["a"]["y"], 1.0).otherwise(p["b"]["y"] - p["a"]["y"]) + p["a"]["x"]),
    )
    return F.size(crosses) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the outer ring and in no hole (even-odd over all rings)."""
    return F.size(F.filter(rings, lambda r: in_ring(x, y, r))) % 2 == 1


def _side(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def legs_cross(p: Column, q: Column) -> Column:
    """Whether two legs cross in their interiors."""
    return (_side(p["a"], p["b"], q["a"]) * _side(p["a"], p["b"], q["b"]) < 0) & (_side(q["a"], q["b"], p["a"]) * _side(q["a"], q["b"], p["b"]) < 0)


def line_within(coords: Column, rings: Column) -> Column:
    """All vertices inside and no leg across the boundary."""
    edges = F.flatten(F.transform(rings, legs))
    crossing = F.exists(legs(coords), lambda p: F.exists(edges, lambda e: legs_cross(p, e)))
    return F.forall(coords, lambda c: in_polygon(c["x"], c["y"], rings)) & ~crossing


def polygons_meet(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: crossing edges, or a vertex of one inside the other."""
    edges = lambda rings: F.flatten(F.transform(rings, legs))
    crossing = F.exists(edges(a), lambda p: F.exists(edges(b), lambda q: legs_cross(p, q)))
    inside = lambda x, y: F.exists(F.flatten(x), lambda c: in_polygon(c["x"], c["y"], y))
    return crossing | inside(a, b) | inside(b, a)


def polygon_distance(x: Column, y: Column, rings: Column) -> Column:
    """0 inside, else the distance to the nearest edge."""
    return F.when(in_polygon(x, y, rings), F.lit(0.0)).otherwise(boundary_distance(x, y, rings))


def boundary_distance(x: Column, y: Column, rings: Column) -> Column:
    return F.sqrt(F.array_min(F.transform(rings, lambda r: polyline_distance2(x, y, r))))


def buffer_area(len_: Column, r: float, unit: float = 1.0) -> Column:
    """Area of a round buffer of a straight line, in ``unit`` square metres (1e4: hectares, 1e6: square kilometres)."""
    return (math.pi * r * r + 2 * r * len_) / unit


def circle_area_ha(r: float) -> float:
    return math.pi * r * r / 1e4


def bounds(coords: Column) -> Column:
    xs, ys = F.transform(coords, lambda c: c["x"]), F.transform(coords, lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def clip_half_plane(ring: Column, a: Column, b: Column) -> Column:
    """One step of polygon clipping: the part of a closed ring to the left of the line from a to b."""

    def cut(p: Column) -> Column:
        s, e = _side(a, b, p["a"]), _side(a, b, p["b"])
        t = s / F.when(s == e, 1.0).otherwise(s - e)
        at = point(p["a"]["x"] + t * (p["b"]["x"] - p["a"]["x"]), p["a"]["y"] + t * (p["b"]["y"] - p["a"]["y"]))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.concat(F.when((s >= 0) != (e >= 0), F.array(at)).otherwise(none), F.when(e >= 0, F.array(p["b"])).otherwise(none))

    kept = F.flatten(F.transform(legs(ring), cut))
    return F.when(F.size(kept) > 0, F.concat(kept, F.slice(kept, 1, 1))).otherwise(kept)


def convex_overlap_area(ring: Column, convex: Column) -> Column:
    """Area of a ring inside a convex counter-clockwise ring."""
    clipped = F.aggregate(legs(convex), ring, lambda r, e: clip_half_plane(r, e["a"], e["b"]))
    return F.abs(ring_area2(clipped)) / 2
