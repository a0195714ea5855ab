"""Buffer features of street segments: counts, densities and statistics within a distance, and nearest neighbours."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geometry as g
from kerbline.functions import scalar as s
from kerbline.operators import gridjoin
from kerbline.operators.rangestats import range_stats
from kerbline.operators.rangesums import one_leg, range_sums
from kerbline.operators.relational import complete
from kerbline.plans.registry import query
from kerbline.plans.tables import EVENT_TYPES, Tables

RADII = (50, 200, 500)
R6 = lambda c, n: F.round(c, 6).alias(n)

#: Squared distance of a point from a segment in SQL.
D2 = """(p.px - (s.x0 + tt * (s.x1 - s.x0))) * (p.px - (s.x0 + tt * (s.x1 - s.x0))) + (p.py - (s.y0 + tt * (s.y1 - s.y0))) * (p.py - (s.y0 + tt * (s.y1 - s.y0)))"""


def pairs_sql(points: str, r: int) -> str:
    """Pairs within r, by a bounding box and then the exact distance."""
    return f"""SELECT *, {D2.replace("s.", "").replace("p.", "")} AS d2 FROM (SELECT s.id, s.x0, s.y0, s.x1, s.y1, p.*,
        coalesce(greatest(0.0, least(1.0, ((p.px - s.x0) * (s.x1 - s.x0) + (p.py - s.y0) * (s.y1 - s.y0)) /
        nullif(CAST((s.x1 - s.x0) * (s.x1 - s.x0) + (s.y1 - s.y0) * (s.y1 - s.y0) AS DOUBLE), 0))), 0.0) AS tt
        FROM segments s JOIN {points} p ON p.px BETWEEN least(s.x0, s.x1) - {r} AND greatest(s.x0, s.x1) + {r}
        AND p.py BETWEEN least(s.y0, s.y1) - {r} AND greatest(s.y0, s.y1) + {r}) WHERE {D2.replace("s.", "").replace("p.", "")} <= {r * r}"""


_LEN = "sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE))"


def seg_length() -> Column:
    return g.hypot((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"))


def poi_density(segments: DataFrame, pois: DataFrame, vocabulary: tuple[str, ...], category: str = "cat_l1", r: float = 200.0) -> DataFrame:
    """Points of each category, and of all others, per hectare within r of a segment; 0 where there are none."""
    kept = s.vocabulary_code(F.col(category), vocabulary).alias("code")
    names = [*vocabulary, "other"]
    sums = range_sums(segments.select("id", one_leg().alias("legs")), pois.select("px", "py", kept), [r], codes={"code": len(names)})
    counts = sums.select("id", *[F.col(f"code_{i}_{r:g}").alias(f"n_{v}") for i, v in enumerate(names)])
    base = segments.select("id", g.buffer_area(seg_length(), r, 1e4).alias("ha"))
    full = complete(base, counts, "id", {f"n_{v}": 0 for v in names})
    return full.select("id", *[R6(F.col(f"n_{v}") / F.col("ha"), f"poi_{v}_buf{int(r)}_density") for v in names])


@query(
    "jn10_poi_density_buf200",
    f"""SELECT s.id, {", ".join(f"round(coalesce(n_{v}, 0) / ((pi() * 40000 + 400 * {_LEN}) / 10000), 6) AS poi_{v}_buf200_density" for v in (*EVENT_TYPES[:5], "other"))}
        FROM segments s LEFT JOIN (SELECT id, {", ".join(f"count(*) FILTER (cat_l1 = '{v}') AS n_{v}" for v in EVENT_TYPES[:5])},
        count(*) FILTER (cat_l1 NOT IN ({", ".join(f"'{v}'" for v in EVENT_TYPES[:5])})) AS n_other FROM ({pairs_sql("pois", 200)}) GROUP BY id) n USING (id)""",
)
def jn10(t: Tables) -> DataFrame:
    return poi_density(t.segments, t.pois, EVENT_TYPES[:5])


@query("agg6_poi_pivot", f"SELECT id, cat_l1, count(*) AS n FROM ({pairs_sql('pois', 200)}) GROUP BY id, cat_l1")
def poi_counts(t: Tables) -> DataFrame:
    """Counts by category as rows; a category outside the vocabulary would be its own, which these tables have none of."""
    code = s.vocabulary_code(F.col("cat_l1"), EVENT_TYPES).alias("code")
    sums = range_sums(t.segments.select("id", one_leg().alias("legs")), t.pois.select("px", "py", code), [200], codes={"code": len(EVENT_TYPES) + 1})
    each = F.array(*[F.struct(F.lit(v).alias("cat_l1"), F.col(f"code_{i}_200").cast("long").alias("n")) for i, v in enumerate(EVENT_TYPES)])
    return sums.select("id", F.inline(each)).where("n > 0")


_NODE_POINTS = """(SELECT node, degree, x AS px, y AS py FROM nodes JOIN (SELECT key, (min({'side': side, 'id': id, 'x': x, 'y': y})).x AS x,
    (min({'side': side, 'id': id, 'x': x, 'y': y})).y AS y FROM (SELECT a AS key, 0 AS side, id, x0 AS x, y0 AS y FROM segments
    UNION ALL SELECT b, 1, id, x1, y1 FROM segments) GROUP BY key) ON key = node)"""


def node_points(t: Tables) -> DataFrame:
    """Nodes at the place where they are met first: all starts before all ends, in order of id."""
    starts = t.segments.select(F.col("a").alias("node"), F.lit(0).alias("side"), "id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    ends = t.segments.select(F.col("b").alias("node"), F.lit(1).alias("side"), "id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    at = starts.unionByName(ends).groupBy("node").agg(F.min(F.struct("side", "id", "x", "y")).alias("o"))
    return at.select("node", F.col("o.x").alias("px"), F.col("o.y").alias("py")).join(t.nodes, "node")


@query(
    "jn7_intersections",
    "SELECT s.id, "
    + ", ".join(
        f"round(coalesce(i{r}, 0) / ((pi() * {r * r} + 2 * {r} * {_LEN}) / 10000), 6) AS net_intx_buf{r}_density, round(CASE WHEN coalesce(n{r}, 0) > 0 THEN CAST(e{r} AS DOUBLE) / n{r} ELSE 0.0 END, 6) AS net_deadend_buf{r}_ratio"
        for r in RADII
    )
    + " FROM segments s LEFT JOIN (SELECT id, "
    + ", ".join(f"count(*) FILTER (d2 <= {r * r}) AS n{r}, count(*) FILTER (d2 <= {r * r} AND degree >= 3) AS i{r}, count(*) FILTER (d2 <= {r * r} AND degree = 1) AS e{r}" for r in RADII)
    + f" FROM ({pairs_sql(_NODE_POINTS, 500)}) GROUP BY id) USING (id)",
)
def intersections(t: Tables) -> DataFrame:
    """All radii from one join at the widest."""
    flag = lambda test, n: test.cast("double").alias(n)
    points = node_points(t).select("px", "py", F.lit(1.0).alias("n"), flag(F.col("degree") >= 3, "i"), flag(F.col("degree") == 1, "e"))
    sums = range_sums(t.segments.select("id", one_leg().alias("legs"), seg_length().alias("len")), points, RADII, values="nie", keep=["len"])
    full = sums.select("id", "len", *[F.col(f"{k}_{r}").alias(f"{k}{r}") for r in RADII for k in "nie"])
    out = []
    for r in RADII:
        out += [R6(F.col(f"i{r}") / g.buffer_area(F.col("len"), r, 1e4), f"net_intx_buf{r}_density"), R6(s.ratio(F.col(f"e{r}").cast("double"), F.col(f"n{r}")), f"net_deadend_buf{r}_ratio")]
    return full.select("id", *out)


_MIDS = f"(SELECT id AS mid, (x0 + x1) / 2.0 AS px, (y0 + y1) / 2.0 AS py, {_LEN} AS len, CAST(least(greatest(floor(fmod(degrees(atan2(y1 - y0, x1 - x0)) + 360.0, 180.0) / 5.0), 0), 35) AS INTEGER) AS bin FROM segments)"


def mids(t: Tables) -> DataFrame:
    return t.segments.select(
        F.col("id").alias("mid"), ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"), seg_length().alias("len"),
        g.bearing_bin(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bin"),
    )


@query(
    "jn8_road_density",
    f"""SELECT s.id, {", ".join(f"round(coalesce(l{r}, 0) / 1000 / ((pi() * {r * r} + 2 * {r} * {_LEN}) / 1000000), 6) AS net_road_buf{r}_density" for r in RADII)}
        FROM segments s LEFT JOIN (SELECT id, {", ".join(f"sum(len) FILTER (d2 <= {r * r}) AS l{r}" for r in RADII)} FROM ({pairs_sql(_MIDS, 500)}) GROUP BY id) USING (id)""",
)
def road_density(t: Tables) -> DataFrame:
    """Whole length of the segments whose midpoint is near, the segment's own included."""
    lines = t.segments.select("id", one_leg().alias("legs"), seg_length().alias("len"))
    sums = range_sums(lines, mids(t).select("px", "py", F.col("len").alias("l")), RADII, values=["l"], keep=["len"])
    full = sums.select("id", "len", *[F.col(f"l_{r}").alias(f"l{r}") for r in RADII])
    return full.select("id", *[R6(F.col(f"l{r}") / 1000 / g.buffer_area(F.col("len"), r, 1e6), f"net_road_buf{r}_density") for r in RADII])


@query(
    "jn8_orientation_entropy",
    f"""SELECT s.id, round(coalesce(e, 0.0), 6) AS net_orientation_buf500_entropy FROM segments s LEFT JOIN (SELECT id, -sum(p * ln(p)) AS e FROM
        (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM (SELECT id, bin, CAST(count(*) AS DOUBLE) AS n FROM ({pairs_sql(_MIDS, 500)}) GROUP BY id, bin)) GROUP BY id) USING (id)""",
)
def orientation(t: Tables) -> DataFrame:
    """Entropy of undirected bearings within 500 in 36 bins."""
    sums = range_sums(t.segments.select("id", one_leg().alias("legs")), mids(t).select("px", "py", "bin"), [500], codes={"bin": 36}, keep=[])
    return sums.select("id", R6(F.abs(s.entropy([F.col(f"bin_{i}_500") for i in range(36)])), "net_orientation_buf500_entropy"))


_STATS = """count(*) AS n, sum(area) AS cover, avg(height) AS hmean, stddev_pop(height) AS hstd, quantile_cont(CAST(height AS DOUBLE), 0.9) AS hp90, median(area) AS amed,
    sum(area * height / 3.0) AS floor, list_sort(list(area)) AS al"""


def _buildings_sql(r: int) -> str:
    return f"""SELECT s.id, coalesce(n, 0) AS n, round(coalesce(cover, 0) / ba, 6) AS coverage, round(coalesce(hmean, 0), 6) AS hmean, round(coalesce(hstd, 0), 6) AS hstd,
        round(coalesce(hp90, 0), 6) AS hp90, round(coalesce(amed, 0), 6) AS amed, round(coalesce(floor, 0) / ba, 6) AS far,
        round(CASE WHEN coalesce(n, 0) < 2 THEN 0.0 ELSE 2 * list_sum(list_transform(range(1, n + 1), lambda i: al[i] * i)) / (n * cover) - (n + 1.0) / n END, 6) AS gini
        FROM (SELECT id, pi() * {r * r} + {2 * r} * {_LEN} AS ba FROM segments) s LEFT JOIN (SELECT id, {_STATS} FROM ({pairs_sql("buildings", r)}) GROUP BY id) USING (id)"""


def buildings_within(t: Tables, r: int) -> DataFrame:
    points = t.buildings.select("px", "py", "area", "height", (F.col("area") * F.col("height") / 3.0).alias("floor"))
    lines = t.segments.select("id", one_leg().alias("legs"), g.buffer_area(seg_length(), r).alias("ba"))
    stats = range_stats(lines, points, [r], ["area", "floor"], ["height"], {"height": 0.9, "area": 0.5}, ["area"], ["ba"])
    got = lambda c: F.col(f"{c}_{r}")
    return stats.select(
        "id", got("n").cast("long").alias("n"), R6(got("area_sum") / F.col("ba"), "coverage"), R6(got("height_mean"), "hmean"), R6(got("height_std"), "hstd"), R6(got("height_q"), "hp90"), R6(got("area_q"), "amed"),
        R6(got("floor_sum") / F.col("ba"), "far"), R6(got("area_gini"), "gini"),
    )


for _r in RADII:
    query(f"jn9_buildings_buf{_r}", _buildings_sql(_r))(functools.partial(buildings_within, r=_r))


@query(
    "jn11_nearest_polygon",
    f"""SELECT id, round(sqrt(min(dx * dx + dy * dy)), 6) AS d FROM (SELECT mid AS id, greatest(b.px - 6 - m.px, m.px - b.px - 6, 0.0) AS dx, greatest(b.py - 5 - m.py, m.py - b.py - height, 0.0) AS dy
        FROM {_MIDS} m CROSS JOIN buildings b) GROUP BY id""",
)
def nearest_polygon(t: Tables) -> DataFrame:
    """Distance to the nearest footprint, 0 inside; footprints are boxes around the centroids."""
    x, y, h = F.col("px").cast("double"), F.col("py").cast("double"), F.col("height")
    box = F.array(g.point(x - 6, y - 5), g.point(x + 6, y - 5), g.point(x + 6, y + h), g.point(x - 6, y + h), g.point(x - 6, y - 5))
    near = gridjoin.nearest_polygon(mids(t).select(F.col("mid").alias("id"), "px", "py"), t.buildings.select("rid", F.array(box).alias("rings")), "id", 250.0)
    return near.select("id", R6(F.col("d"), "d"))


@query(
    "jn11_nearest_building",
    f"""SELECT mid AS id, (min({{'d': d2, 'i': rid}})).i AS rid, round(sqrt((min({{'d': d2, 'i': rid}})).d), 6) AS setback, CAST(CASE WHEN sqrt((min({{'d': d2, 'i': rid}})).d) <= 15 THEN 1 ELSE 0 END AS INTEGER) AS wall
        FROM (SELECT mid, rid, (m.px - b.px) * (m.px - b.px) + (m.py - b.py) * (m.py - b.py) AS d2 FROM {_MIDS} m CROSS JOIN buildings b) GROUP BY mid""",
)
def nearest_building(t: Tables) -> DataFrame:
    points = mids(t).select(F.col("mid").alias("id"), "px", "py")
    right = t.buildings.select("rid", F.col("px").alias("rx"), F.col("py").alias("ry"))
    near = gridjoin.nearest_join(points, right, "id", 250.0)
    return near.select("id", "rid", R6(F.col("d"), "setback"), (F.col("d") <= 15).cast("int").alias("wall"))


_TOP = 'SELECT CAST(row_number() OVER (ORDER BY value DESC, "row", col) AS INTEGER) AS rank, col * 80.0 + 40 AS cx, 10240 - "row" * 80.0 - 40 AS cy FROM cells ORDER BY value DESC, "row", col LIMIT 8'


@query(
    "jn12_subcentres",
    f"""SELECT id, round(min(d), 6) AS d1, round(list_sort(list(d))[2], 6) AS d2, (min({{'d': d, 'r': rank}})).r AS rank
        FROM (SELECT mid AS id, rank, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS d FROM {_MIDS} CROSS JOIN ({_TOP})) GROUP BY id""",
)
def subcentres(t: Tables) -> DataFrame:
    from kerbline.plans.core import peaks

    centres = peaks(t).select("rank", (F.col("col") * 80.0 + 40).alias("cx"), (10240 - F.col("row") * 80.0 - 40).alias("cy"))
    near = gridjoin.nearest_of_few(mids(t).select(F.col("mid").alias("id"), "px", "py"), centres, "id")
    return near.select("id", R6(F.col("d1"), "d1"), R6(F.col("d2"), "d2"), "rank")


#: A boundary with a dent, closed, as (x, y); and a convex one, counter-clockwise (fixed values of the queries).
BOUNDARY = ((500, 500), (9500, 800), (7000, 5000), (9200, 9300), (5000, 7600), (900, 9400), (500, 500))
CONVEX = ((2000, 1000), (8000, 2000), (7500, 8000), (2500, 7000), (2000, 1000))


def ring(points: tuple[tuple[float, float], ...]) -> Column:
    return F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in points])


def _inside_sql(x: str, y: str) -> str:
    """Ray casting over the edges of BOUNDARY, spelled out."""
    tests = [
        f"CAST((({ay} > {y}) <> ({by} > {y})) AND {x} < ({bx} - {ax}) * ({y} - {ay}) / CAST({by - ay or 1} AS DOUBLE) + {ax} AS INTEGER)"
        for (ax, ay), (bx, by) in zip(BOUNDARY, BOUNDARY[1:])
    ]
    return f"({' + '.join(tests)}) % 2 = 1"


def boundary() -> Column:
    return F.array(ring(BOUNDARY))


@query("jn13_point_in_polygon", f"SELECT event_id FROM pois WHERE {_inside_sql('px', 'py')}")
def point_in_polygon(t: Tables) -> DataFrame:
    """A box test before the exact one."""
    xs, ys = zip(*BOUNDARY)
    d = t.pois.where(F.col("px").between(min(xs), max(xs)) & F.col("py").between(min(ys), max(ys)))
    return d.where(g.in_polygon(F.col("px"), F.col("py"), boundary())).select("event_id")


def _cross_sql() -> str:
    side = lambda ax, ay, bx, by, cx, cy: f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"
    return " OR ".join(
        f"(sign({side('x0', 'y0', 'x1', 'y1', ax, ay)}) * sign({side('x0', 'y0', 'x1', 'y1', bx, by)}) < 0 AND sign({side(ax, ay, bx, by, 'x0', 'y0')}) * sign({side(ax, ay, bx, by, 'x1', 'y1')}) < 0)"
        for (ax, ay), (bx, by) in zip(BOUNDARY, BOUNDARY[1:])
    )


@query("jn15_line_within", f"SELECT id FROM segments WHERE {_inside_sql('x0', 'y0')} AND {_inside_sql('x1', 'y1')} AND NOT ({_cross_sql()})")
def line_within(t: Tables) -> DataFrame:
    coords = F.array(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y1")))
    return t.segments.where(g.line_within(coords, boundary())).select("id")


@query(
    "jn14_16_box_overlap",
    """SELECT brand, (max({'a': area, 'i': -rid})).a AS best, -(max({'a': area, 'i': -rid})).i AS rid FROM (SELECT brand, rid, round(greatest(0.0, least(px + 400, 6000) - greatest(px - 400, 3000)) *
       greatest(0.0, least(py + 300, 7000) - greatest(py - 300, 2000)), 6) AS area FROM buildings) WHERE area > 0 GROUP BY brand""",
)
def best_overlap(t: Tables) -> DataFrame:
    """The footprint of each brand with the largest part inside a polygon: polygon clipping, then the greatest area."""
    x, y = F.col("px").cast("double"), F.col("py").cast("double")
    box = F.array(g.point(x - 400, y - 300), g.point(x + 400, y - 300), g.point(x + 400, y + 300), g.point(x - 400, y + 300), g.point(x - 400, y - 300))
    window = ring(((3000, 2000), (6000, 2000), (6000, 7000), (3000, 7000), (3000, 2000)))
    near = t.buildings.where((x + 400 >= 3000) & (x - 400 <= 6000) & (y + 300 >= 2000) & (y - 300 <= 7000))
    area = near.select("brand", "rid", F.round(g.convex_overlap_area(box, window), 6).alias("area")).where("area > 0")
    best = area.groupBy("brand").agg(F.max(F.struct("area", (-F.col("rid")).alias("i"))).alias("m"))
    return best.select("brand", F.col("m.area").alias("best"), (-F.col("m.i")).alias("rid"))


_EDGE = ", ".join(
    f"(px - ({ax} + t{i} * {bx - ax})) * (px - ({ax} + t{i} * {bx - ax})) + (py - ({ay} + t{i} * {by - ay})) * (py - ({ay} + t{i} * {by - ay}))"
    for i, ((ax, ay), (bx, by)) in enumerate(zip(BOUNDARY, BOUNDARY[1:]))
)
_TS = ", ".join(
    f"greatest(0.0, least(1.0, ((px - {ax}) * {bx - ax} + (py - {ay}) * {by - ay}) / {float((bx - ax) ** 2 + (by - ay) ** 2)})) AS t{i}"
    for i, ((ax, ay), (bx, by)) in enumerate(zip(BOUNDARY, BOUNDARY[1:]))
)


@query("geo8_9_edge_distance", f"SELECT event_id, round(sqrt(least({_EDGE})), 6) AS edge, round(CASE WHEN {_inside_sql('px', 'py')} THEN 0.0 ELSE sqrt(least({_EDGE})) END, 6) AS outside FROM (SELECT *, {_TS} FROM pois)")
def edge_distance(t: Tables) -> DataFrame:
    x, y = F.col("px"), F.col("py")
    return t.pois.select("event_id", R6(g.boundary_distance(x, y, boundary()), "edge"), R6(g.polygon_distance(x, y, boundary()), "outside"))


CIRCLE_HA = math.pi * 200 * 200 / 1e4
