"""Relational, scalar, aggregate and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geometry as g
from kerbline.functions import scalar as s
from kerbline.functions import utm
from kerbline.operators import relational as rel
from kerbline.plans.registry import query
from kerbline.plans.tables import EVENT_TYPES, Tables
from kerbline.sources import roads, vector

R6 = lambda c, n: F.round(c, 6).alias(n)


@query("prj1_3_5_project", "SELECT id, x0, CAST(x0 AS DOUBLE) / 2 AS half, CAST(y0 AS INTEGER) AS y FROM segments")
def project(t: Tables) -> DataFrame:
    return t.segments.select("id", "x0", (F.col("x0").cast("double") / 2).alias("half"), F.col("y0").cast("int").alias("y"))


@query("prj4_number_rows", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS n FROM orders")
def number(t: Tables) -> DataFrame:
    return rel.number_rows(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("n").cast("long").alias("n"))


@query("prj6_8_parse_and_drop", "SELECT event_id, TRY_CAST(cat_l2 AS DOUBLE) AS k FROM pois WHERE TRY_CAST(cat_l2 AS DOUBLE) IS NOT NULL")
def parse(t: Tables) -> DataFrame:
    d = t.pois.select("event_id", s.to_number(F.col("cat_l2")).alias("k"))
    return d.dropna(subset=["k"]).where(~F.isnan("k") & (F.abs("k") < float("inf")))


@query(
    "prj9_10_membership",
    "SELECT id, CAST(CASE WHEN highway IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS TINYINT) AS minor FROM segments WHERE highway <> '5-LOW'",
)
def membership(t: Tables) -> DataFrame:
    d = t.segments.where(F.col("highway") != "5-LOW")
    return d.select("id", (~F.col("highway").isin("1-URGENT", "2-HIGH")).cast("tinyint").alias("minor"))


@query("prj11_bbox", "SELECT event_id, px, py FROM pois WHERE px BETWEEN 1000 AND 4000 AND py BETWEEN 2000 AND 9000")
def bbox(t: Tables) -> DataFrame:
    return t.pois.where(F.col("px").between(1000, 4000) & F.col("py").between(2000, 9000)).select("event_id", "px", "py")


@query(
    "prj12_13_cells",
    """SELECT id, CAST(floor(x0 / 80.0) AS INTEGER) AS col, CAST(floor((y0 - 10240.0) / -80.0) AS INTEGER) AS "row",
       CAST(least(greatest(floor(x0 / 80.0), 0), 127) AS INTEGER) AS clamped, x1 >= 0 AND x1 < 10240 AND y1 >= 0 AND y1 < 10240 AS end_inside FROM segments""",
)
def cell_of(t: Tables) -> DataFrame:
    col = s.cell_index(F.col("x0"), 0.0, 80.0)
    inside = (F.col("x1") >= 0) & (F.col("x1") < 10240) & (F.col("y1") >= 0) & (F.col("y1") < 10240)
    row = s.cell_index(F.col("y0"), 10240.0, -80.0)
    return t.segments.select("id", col.alias("col"), row.alias("row"), F.least(F.greatest(col, F.lit(0)), F.lit(127)).alias("clamped"), inside.alias("end_inside"))


@query(
    "prj14_17_guards",
    """SELECT rid, round(CASE WHEN height - 10 > 0 THEN area / (height - 10) ELSE 1.0 END, 6) AS q,
       round(least(greatest(area / 1000.0, 1.0), 1.5), 6) AS clipped, coalesce(CASE WHEN height > 25 THEN height END, 0) AS tall FROM buildings""",
)
def guards(t: Tables) -> DataFrame:
    tall = F.coalesce(F.when(F.col("height") > 25, F.col("height")), F.lit(0))
    return t.buildings.select(
        "rid", R6(s.ratio(F.col("area"), F.col("height") - 10, 1.0), "q"), R6(s.clip(F.col("area") / 1000.0, 1.0, 1.5), "clipped"), tall.alias("tall")
    )


@query(
    "prj18_one_hot",
    "SELECT event_id, "
    + ", ".join(f"CAST(CASE WHEN cat_l1 = '{v}' THEN 1 ELSE 0 END AS TINYINT) AS is_{v}" for v in EVENT_TYPES[:3])
    + ", CAST(CASE WHEN cat_l1 IN ('click', 'error', 'purchase') THEN 0 ELSE 1 END AS TINYINT) AS is_other FROM pois",
)
def one_hot(t: Tables) -> DataFrame:
    return t.pois.select("event_id", *s.one_hot(F.col("cat_l1"), EVENT_TYPES[:3], "is_"))


@query(
    "prj19_20_vocabulary",
    """SELECT event_id, CASE cat_l1 WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS code,
       cat_l1 IN ('click', 'error', 'view') AS known FROM pois""",
)
def vocabulary(t: Tables) -> DataFrame:
    code = s.vocabulary_code(F.col("cat_l1"), ("click", "error", "view"))
    return t.pois.select("event_id", code.alias("code"), (code < 3).alias("known"))


_ROADS = "['footway', 'service']", "Motorway_link", "unclassified", "['residential', 'pedestrian']", "steps", "Living_Street", "['cycleway', 'path']"
#: What each of them is, and classes in order, spelled out so that the operator's own list is not asked.
_ORDERED = (
    "motorway trunk primary secondary tertiary pedestrian residential living_street service bridleway footway path steps track corridor "
    "elevator cycleway"
).split()
_PICK = "CASE " + " ".join(f"WHEN id % 7 = {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(_ROADS)) + " END"


@query(
    "str1_2_road_class",
    f"""SELECT id, CASE {" ".join(f"WHEN contains(lower(h), '{c}') THEN '{c}'" for c in _ORDERED)} END AS road FROM (SELECT id, {_PICK} AS h FROM segments)
        WHERE h <> 'unclassified'""",
)
def road_class(t: Tables) -> DataFrame:
    h = F.element_at(F.array(*map(F.lit, _ROADS)), (F.col("id") % 7 + 1).cast("int"))
    return t.segments.select("id", s.road_class(h).alias("road")).where("road is not null")


@query(
    "prj21_22_heights",
    """WITH raw AS (SELECT rid, CASE WHEN rid % 7 = 0 THEN 'none' WHEN rid % 5 = 0 THEN '0' ELSE CAST(height AS VARCHAR) END AS v FROM buildings),
       good AS (SELECT rid, CASE WHEN try_cast(v AS DOUBLE) > 0 THEN try_cast(v AS DOUBLE) END AS m FROM raw),
       filled AS (SELECT rid, coalesce(m, (SELECT median(m) FROM good)) AS m FROM good),
       both_of AS (SELECT 'HGT' AS source, 1 AS k UNION ALL SELECT 'Floors', 3 UNION ALL SELECT 'none', 0)
       SELECT rid, source, round(least(k * m, 2 * k * (SELECT quantile_cont(m, 0.99) FROM filled)), 6) AS height FROM filled, both_of""",
)
def heights(t: Tables) -> DataFrame:
    """Metres before storeys, storeys times three, and nothing known."""
    text = F.when(F.col("rid") % 7 == 0, "none").when(F.col("rid") % 5 == 0, "0").otherwise(F.col("height").cast("string"))
    raw = t.buildings.select("rid", text.alias("HGT"), F.lit("9").alias("Floors"))
    tables = {"HGT": raw, "Floors": raw.select("rid", F.col("HGT").alias("Floors")), "none": raw.select("rid", F.col("HGT").alias("Elevation"))}
    parts = [vector.heights(d).select("rid", F.lit(name).alias("source"), R6(F.col("height"), "height")) for name, d in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NEAR = "{c} / 1000.0 + ({k} % 3) * 0.0000004"


@query(
    "mth5_node_keys",
    f"""SELECT x, y, count(*) AS ends FROM (SELECT round_even({_NEAR.format(c="x0", k="id")}, 6) AS x, round_even({_NEAR.format(c="y0", k="a")}, 6) AS y FROM segments)
        GROUP BY x, y""",
)
def node_keys(t: Tables) -> DataFrame:
    """Ends less than half a millionth apart are one node."""
    near = lambda c, k: F.col(c) / 1000.0 + (F.col(k) % 3) * 0.0000004
    d = t.segments.select(roads.node_key(F.struct(near("x0", "id").alias("x"), near("y0", "a").alias("y"))).alias("n"))
    return d.groupBy("n").agg(F.count("*").alias("ends")).select("n.x", "n.y", "ends")


#: Points in well-known binary, of either byte order, and no point (fixed values).
_WKB = {
    "0101000000000000000000F83F00000000000002C0": "(1.5, -2.25)", "0101000000C3F5285C8F8252C0D7A3703D0A574440": "(-74.04, 40.68)",
    "00000000013FF80000000000000000000000000000": "(1.5, 0.0)", "0102000000000000000000F83F00000000000002C0": "(NULL, NULL)",
}


@query("geo0_point", "SELECT wkb, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES " + ", ".join(f"('{k}', {v[1:-1]})" for k, v in _WKB.items()) + ") AS v(wkb, x, y)")
def point(t: Tables) -> DataFrame:
    d = t.spark.createDataFrame([(k,) for k in _WKB], "wkb string")
    return d.select("wkb", vector.wkb_point(F.unhex("wkb")).alias("p")).select("wkb", "p.x", "p.y")


@query(
    "str4_5_arr1_2_jsn1_text",
    """SELECT o_orderkey, replace(o_orderpriority, '-', ' ') AS name, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END, '') AS st,
       string_split(o_orderpriority, '-')[1] AS l1, string_split(o_orderpriority, '-')[3] AS l3, CAST(to_json(string_split(o_orderpriority, '-')) AS VARCHAR) AS j FROM orders""",
)
def text(t: Tables) -> DataFrame:
    parts = F.split("o_orderpriority", "-")
    status = F.coalesce(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")), F.lit(""))
    return t.orders.select(
        "o_orderkey", F.replace("o_orderpriority", F.lit("-"), F.lit(" ")).alias("name"), status.alias("st"),
        F.try_element_at(parts, F.lit(1)).alias("l1"), F.get(parts, 2).alias("l3"), F.to_json(parts).alias("j"),
    )


@query(
    "mth1_4_scalars",
    """SELECT rid, round(sqrt(area), 6) AS root, round(abs(area - 1500), 6) AS off, round(ln(area), 6) AS lg, CAST(ceil(area / 7) AS BIGINT) AS up,
       CAST(floor((area - 1500) / 7) AS BIGINT) AS down, round(sqrt(px * px + py * py), 6) AS far FROM buildings""",
)
def scalars(t: Tables) -> DataFrame:
    a = F.col("area")
    far = g.hypot(F.col("px").cast("double"), F.col("py").cast("double"))
    return t.buildings.select(
        "rid", R6(F.sqrt(a), "root"), R6(F.abs(a - 1500), "off"), R6(F.ln(a), "lg"), F.ceil(a / 7).cast("long").alias("up"), F.floor((a - 1500) / 7).cast("long").alias("down"), R6(far, "far")
    )


_LEN, _MX = "sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE))", "(x0 + x1) / 2.0"


@query(
    "geo1_3_mth2_9_segment_geometry",
    f"""SELECT id, round({_LEN}, 6) AS len, round({_MX}, 6) AS mx, round((y0 + y1) / 2.0, 6) AS my,
        CAST(least(greatest(floor(fmod(degrees(atan2(y1 - y0, x1 - x0)) + 360.0, 180.0) / 5.0), 0), 35) AS INTEGER) AS bin,
        CASE WHEN {_LEN} > 1e-6 THEN 1.0 ELSE 0.0 END::DOUBLE AS straight, 1.0::DOUBLE AS circuity,
        round((pi() * 40000 + 400 * {_LEN}) / 10000, 6) AS buffer_ha FROM segments""",
)
def segment_geometry(t: Tables) -> DataFrame:
    coords = F.array(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y1")))
    d = t.segments.withColumn("coords", coords)
    d = d.withColumns({"len": g.length(F.col("coords")), "mid": g.midpoint(F.col("coords")), "chord": g.chord(F.col("coords"))})
    return d.select(
        "id", R6(F.col("len"), "len"), R6(F.col("mid.x"), "mx"), R6(F.col("mid.y"), "my"), g.bearing_bin(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bin"),
        g.straightness(F.col("len"), F.col("chord")).alias("straight"), g.circuity(F.col("len"), F.col("chord")).alias("circuity"),
        R6(g.buffer_area(F.col("len"), 200.0, 1e4), "buffer_ha"),
    )


@query(
    "geo4_5_mth8_polygons",
    """SELECT rid, round(w * h - 1.0, 6) AS area, round(2 * (w + h) + 4.0, 6) AS perimeter, round(px + w / 2, 6) AS cx, round(py + h / 2, 6) AS cy,
       round(4 * pi() * (w * h - 1.0) / pow(2 * (w + h) + 4.0, 2), 6) AS compact FROM (SELECT rid, px, py, height + 5.0 AS w, height % 7 + 3.0 AS h FROM buildings)""",
)
def polygons(t: Tables) -> DataFrame:
    """A rectangle with a unit hole for every building."""
    d = t.buildings.select("rid", "px", "py", (F.col("height") + 5.0).alias("w"), (F.col("height") % 7 + 3.0).alias("h"))

    def ring(x0, y0, x1, y1):
        return F.array(g.point(x0, y0), g.point(x1, y0), g.point(x1, y1), g.point(x0, y1), g.point(x0, y0))

    x, y = F.col("px"), F.col("py")
    rings = F.array(ring(x, y, x + F.col("w"), y + F.col("h")), ring(x + 1, y + 1, x + 2, y + 2))
    d = d.withColumn("rings", rings).withColumn("c", g.ring_centroid(F.get("rings", 0)))
    area, perimeter = g.polygon_area(F.col("rings")), g.polygon_perimeter(F.col("rings"))
    return d.select("rid", R6(area, "area"), R6(perimeter, "perimeter"), R6(F.col("c.x"), "cx"), R6(F.col("c.y"), "cy"), R6(g.compactness(area, perimeter), "compact"))


@query("geo12_utm_round_trip", "SELECT event_id, round(-74.5 + px / 10007.0, 4) AS lon, round(40.2 + py / 10007.0, 4) AS lat, 18 AS zone FROM pois WHERE -74.5 + px / 10007.0 >= -78 AND -74.5 + px / 10007.0 < -72")
def utm_round_trip(t: Tables) -> DataFrame:
    d = t.pois.select("event_id", (F.col("px") / 10007.0 - 74.5).alias("lon"), (F.col("py") / 10007.0 + 40.2).alias("lat"))
    d = d.withColumn("zone", utm.zone(F.col("lon"))).withColumn("p", utm.forward(F.col("lon"), F.col("lat"), F.col("zone")))
    d = d.withColumn("q", utm.inverse(F.col("p.x"), F.col("p.y"), F.col("zone")))
    return d.select("event_id", F.round("q.lon", 4).alias("lon"), F.round("q.lat", 4).alias("lat"), "zone")


@query(
    "agg1_6_brand_stats",
    """SELECT brand, count(*) AS n, count(*) FILTER (height > 25) AS tall, round(sum(area), 4) AS area, round(stddev_pop(height), 6) AS std, round(avg(height), 6) AS mean,
       round(quantile_cont(CAST(height AS DOUBLE), 0.9), 6) AS p90, round(median(area), 6) AS med FROM buildings GROUP BY brand""",
)
def brand_stats(t: Tables) -> DataFrame:
    return t.buildings.groupBy("brand").agg(
        F.count("*").alias("n"), F.count_if(F.col("height") > 25).alias("tall"), F.round(F.sum("area"), 4).alias("area"), R6(F.stddev_pop("height"), "std"), R6(F.avg("height"), "mean"),
        R6(F.percentile("height", 0.9), "p90"), R6(F.median("area"), "med"),
    )


@query(
    "agg9_gini",
    """SELECT brand, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE 2 * sum(area * i) / (count(*) * sum(area)) - (count(*) + 1.0) / count(*) END, 6) AS gini
       FROM (SELECT brand, area, row_number() OVER (PARTITION BY brand ORDER BY area) AS i FROM buildings WHERE area > 0) GROUP BY brand""",
)
def gini(t: Tables) -> DataFrame:
    return t.buildings.groupBy("brand").agg(R6(s.gini(F.col("area")), "gini"))


@query(
    "agg10_13_max_normalise",
    """SELECT rid, round(area / (SELECT max(area) FROM buildings), 6) AS rel, area >= (SELECT quantile_cont(area, 0.9) FROM buildings) AS core,
       round(coalesce(CASE WHEN height > 5 THEN height END, (SELECT median(height) FROM buildings WHERE height > 5)), 6) AS filled,
       round(area / (SELECT sum(area) FROM buildings), 12) AS share FROM buildings""",
)
def max_normalise(t: Tables) -> DataFrame:
    """Global scalars come back as one broadcast row."""
    one = t.buildings.agg(F.max("area").alias("m"), F.sum("area").alias("total"))
    q = rel.quantiles(t.buildings, "area", [0.9]).select(F.get("q", 0).alias("q"))
    h = rel.quantiles(t.buildings.where("height > 5"), "height", [0.5]).select(F.get("q", 0).alias("h"))
    d = t.buildings.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(q)).crossJoin(F.broadcast(h))
    filled = F.coalesce(F.when(F.col("height") > 5, F.col("height").cast("double")), F.col("h"))
    return d.select("rid", R6(F.col("area") / F.col("m"), "rel"), (F.col("area") >= F.col("q")).alias("core"), R6(filled, "filled"), F.round(F.col("area") / F.col("total"), 12).alias("share"))


@query(
    "agg16_entropy",
    """SELECT a, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT a, n / sum(n) OVER (PARTITION BY a) AS p FROM
       (SELECT a, highway, CAST(count(*) AS DOUBLE) AS n FROM segments GROUP BY a, highway)) GROUP BY a""",
)
def entropy(t: Tables) -> DataFrame:
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = t.segments.groupBy("a").agg(*[F.count_if(F.col("highway") == k).cast("double").alias(f"n{i}") for i, k in enumerate(kinds)])
    return wide.select("a", R6(s.entropy([F.col(f"n{i}") for i in range(len(kinds))]), "entropy"))


@query("agg17_row_sum", "SELECT rid, round(area + height + px, 6) AS total FROM buildings")
def row_sum(t: Tables) -> DataFrame:
    return t.buildings.select("rid", R6(F.col("area") + F.col("height") + F.col("px"), "total"))


@query(
    "agg18_keep_first",
    "SELECT a, b, id FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, id, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY id) AS n FROM segments) WHERE n = 1",
)
def keep_first(t: Tables) -> DataFrame:
    d = t.segments.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "id")
    return rel.keep_first(d, ["a", "b"], ["id"])


@query(
    "agg19_set2_3_surrogate_ids",
    """SELECT key, CAST(row_number() OVER (ORDER BY side, ord, key) AS BIGINT) AS node FROM (SELECT key, (min(ROW(side, ord))).side AS side, (min(ROW(side, ord))).ord AS ord
       FROM (SELECT a AS key, 0 AS side, id AS ord FROM segments UNION ALL SELECT b, 1, id FROM segments) GROUP BY key)""".replace("ROW(side, ord)", "{'side': side, 'ord': ord}"),
)
def surrogate_ids(t: Tables) -> DataFrame:
    out = rel.surrogate_ids(t.segments.select("a", "b", F.col("id").alias("ord")), "a", "b", ["ord"])
    return out.select("key", F.col("node").cast("long").alias("node"))


@query("agg20_fused_edges", "SELECT u, v, round(w, 6) AS w FROM edges")
def fused_edges(t: Tables) -> DataFrame:
    return t.edges.select("u", "v", R6(F.col("w"), "w"))


@query("agg21_degree", "SELECT node, degree FROM nodes")
def degree(t: Tables) -> DataFrame:
    return t.nodes


@query("agg22_top4_largest_group", "SELECT highway, count(*) AS n FROM segments GROUP BY highway ORDER BY n DESC, highway LIMIT 1")
def largest_group(t: Tables) -> DataFrame:
    return t.segments.groupBy("highway").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "highway").limit(1)


@query("agg25_geo13_bounds", "SELECT min(least(x0, x1)) - 100 AS xmin, min(least(y0, y1)) - 100 AS ymin, max(greatest(x0, x1)) + 100 AS xmax, max(greatest(y0, y1)) + 100 AS ymax FROM segments")
def bounds(t: Tables) -> DataFrame:
    lo, hi = (lambda a, b: F.min(F.least(a, b)) - 100), (lambda a, b: F.max(F.greatest(a, b)) + 100)
    return t.segments.agg(lo("x0", "x1").alias("xmin"), lo("y0", "y1").alias("ymin"), hi("x0", "x1").alias("xmax"), hi("y0", "y1").alias("ymax"))


@query("top1_peaks", 'SELECT "row", col, value, CAST(row_number() OVER (ORDER BY value DESC, "row", col) AS INTEGER) AS rank FROM cells ORDER BY value DESC, "row", col LIMIT 8')
def peaks(t: Tables) -> DataFrame:
    top = t.cells.select("row", "col", "value").orderBy(F.desc("value"), "row", "col").limit(8)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "row", "col")))


@query(
    "top2_3_5_order_statistics",
    "SELECT brand, min({'a': area, 'i': rid}).i AS least, list_sort(list(area))[2] AS second, max({'a': area, 'i': rid}).i AS most FROM buildings GROUP BY brand",
)
def order_statistics(t: Tables) -> DataFrame:
    pair = F.struct("area", "rid")
    return t.buildings.groupBy("brand").agg(
        F.min(pair)["rid"].alias("least"), F.get(F.sort_array(F.collect_list("area")), 1).alias("second"), F.max(pair)["rid"].alias("most")
    )


@query("set1_union_by_name", "SELECT rid, height, NULL::BIGINT AS levels FROM buildings WHERE height > 25 UNION ALL SELECT rid, NULL, height::BIGINT FROM buildings WHERE height <= 25")
def union_by_name(t: Tables) -> DataFrame:
    a = t.buildings.where("height > 25").select("rid", "height")
    b = t.buildings.where("height <= 25").select("rid", F.col("height").cast("long").alias("levels"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set5_mosaic", 'SELECT "row", col, CASE WHEN (row + col) % 5 = 0 THEN value ELSE 1000 END AS value FROM cells'.replace("(row", '("row"'))
def mosaic(t: Tables) -> DataFrame:
    from kerbline.operators import raster

    first = t.cells.select(F.lit(1).alias("tile"), "row", "col", F.when((F.col("row") + F.col("col")) % 5 != 0, 1000.0).alias("value"))
    return raster.mosaic(first.unionByName(t.cells.select(F.lit(2).alias("tile"), "row", "col", "value")))


@query("jn2_3_lookup", "SELECT s.id, c.c_nationkey AS k FROM segments s LEFT JOIN customer c ON c.c_custkey = s.b")
def lookup(t: Tables) -> DataFrame:
    return t.segments.join(t.customer.select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("k")), "b", "left").select("id", "k")


@query(
    "jn4_two_sided_degree",
    "SELECT s.id, (coalesce(a.degree, 0) + coalesce(b.degree, 0)) / 2.0::DOUBLE AS degree FROM segments s LEFT JOIN nodes a ON a.node = s.a LEFT JOIN nodes b ON b.node = s.b",
)
def two_sided(t: Tables) -> DataFrame:
    return rel.two_sided(t.segments.select("id", "a", "b"), t.nodes, "a", "b", "node", "degree", "degree").select("id", "degree")


@query(
    "jn5_6_left_chain",
    """SELECT d.doc_id, d.lang, l.quality, l.toxic, n.words FROM documents d LEFT JOIN labels l USING (doc_id)
       LEFT JOIN (SELECT doc_id, n_chars // 6 AS words FROM documents WHERE doc_id % 2 = 0) n USING (doc_id)""",
)
def left_chain(t: Tables) -> DataFrame:
    even = t.documents.where("doc_id % 2 = 0").select("doc_id", F.floor(F.col("n_chars") / 6).alias("words"))
    return rel.left_chain(t.documents.select("doc_id", "lang"), [t.labels, even], "doc_id")


@query("prj15_23_pad_to_contract", "SELECT doc_id::DOUBLE AS doc_id, coalesce(quality, 0)::DOUBLE AS quality, 0.0::DOUBLE AS absent FROM documents LEFT JOIN labels USING (doc_id)")
def pad(t: Tables) -> DataFrame:
    return rel.pad_columns(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), ["doc_id", "quality", "absent"])
