"""Raster kernels, windows and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geometry as g
from kerbline.functions import scalar as s
from kerbline.operators import raster
from kerbline.operators.relational import quantiles
from kerbline.plans.buffers import BOUNDARY, _inside_sql, boundary
from kerbline.plans.registry import query
from kerbline.plans.tables import AFFINE, BLUE, COVER, GREEN, IMPERVIOUS, SIDE, Tables

R6 = lambda c, n: F.round(c, 6).alias(n)


def _offsets_sql(offsets: list[tuple[int, int]]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {j})" for i, j in offsets) + ") AS o(i, j)"


@query(
    "win6_jn21_disk_sum",
    f"""SELECT CAST("row" - i AS INTEGER) AS "row", CAST(col - j AS INTEGER) AS col, sum(value) AS s, round(sum(value) / {g.circle_area_ha(200.0)}, 6) AS density
        FROM cells, {_offsets_sql(raster.disk_offsets(200, 80))} WHERE "row" - i BETWEEN 0 AND 127 AND col - j BETWEEN 0 AND 127 GROUP BY 1, 2""",
)
def disk_sum(t: Tables) -> DataFrame:
    out = raster.disk_sum(t.cells, 200, 80, SIDE, SIDE)
    return out.select("row", "col", "s", R6(F.col("s") / g.circle_area_ha(200.0), "density"))


@query(
    "win7_disk_mean_std",
    f"""SELECT CAST("row" - i AS INTEGER) AS "row", CAST(col - j AS INTEGER) AS col, round(avg(dem), 5) AS mean, round(stddev_pop(dem), 5) AS std
        FROM cells, {_offsets_sql(raster.disk_offsets(200, 80, 80, False))} WHERE "row" - i BETWEEN 0 AND 127 AND col - j BETWEEN 0 AND 127 GROUP BY 1, 2""",
)
def disk_mean_std(t: Tables) -> DataFrame:
    out = raster.disk_mean_std(t.dem, 200, 80, 80, SIDE, SIDE)
    return out.select("row", "col", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


_GREEN = f"CASE WHEN value IN {GREEN} THEN 1 ELSE 0 END"


@query(
    "win3_4_ras6_box_mean_std",
    f"""SELECT CAST(c."row" AS INTEGER) AS "row", CAST(c.col AS INTEGER) AS col, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cover c, (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS j) b,
        (SELECT "row" AS r, col AS k, {_GREEN} AS v FROM cover) n WHERE n.r = least(greatest(c."row" + i, 0), 127) AND n.k = least(greatest(c.col + j, 0), 127) GROUP BY 1, 2""",
)
def box(t: Tables) -> DataFrame:
    band = t.cover.withColumn("value", F.col("value").isin(*GREEN).cast("int"))
    out = raster.box_mean_std(band, 50, SIDE, SIDE)
    return out.select("row", "col", R6(F.col("mean"), "mean"), R6(F.col("std"), "std"))


@query(
    "agg17_cover_shares",
    f"""SELECT CAST("row" // 8 AS INTEGER) AS br, CAST(col // 8 AS INTEGER) AS bc, {", ".join(f"round(count(*) FILTER (value = {c}) / 64.0, 6) AS s{c}" for c in COVER)},
        round(count(*) FILTER (value IN {GREEN}) / 64.0, 6) AS green, round(count(*) FILTER (value = {BLUE[0]}) / 64.0, 6) AS blue, round(count(*) FILTER (value = {IMPERVIOUS[0]}) / 64.0, 6) AS impervious,
        round(-({" + ".join(f"CASE WHEN count(*) FILTER (value = {c}) > 0 THEN count(*) FILTER (value = {c}) / 64.0 * ln(count(*) FILTER (value = {c}) / 64.0) ELSE 0 END" for c in COVER)}), 6) AS entropy FROM cover GROUP BY 1, 2""",
)
def cover_shares(t: Tables) -> DataFrame:
    n = {c: F.count_if(F.col("value") == c).cast("double").alias(f"n{c}") for c in COVER}
    d = t.cover.groupBy(F.floor(F.col("row") / 8).cast("int").alias("br"), F.floor(F.col("col") / 8).cast("int").alias("bc")).agg(*n.values())
    share = lambda codes: sum((F.col(f"n{c}") for c in codes[1:]), F.col(f"n{codes[0]}")) / 64.0
    return d.select(
        "br", "bc", *[R6(share((c,)), f"s{c}") for c in COVER], R6(share(GREEN), "green"), R6(share(BLUE), "blue"), R6(share(IMPERVIOUS), "impervious"), R6(s.entropy([F.col(f"n{c}") for c in COVER]), "entropy")
    )


@query(
    "win5_box_percentiles",
    """SELECT "row", col, list_sort(list(v))[CAST(ceil(0.1 * count(*)) AS INTEGER)] AS p10, list_sort(list(v))[CAST(ceil(0.5 * count(*)) AS INTEGER)] AS p50, list_sort(list(v))[CAST(ceil(0.9 * count(*)) AS INTEGER)] AS p90
       FROM (SELECT a."row", a.col, round(n.dem, 6) AS v FROM cells a, (SELECT unnest(range(-2, 3)) AS i) x, (SELECT unnest(range(-2, 3)) AS j) y, cells n
       WHERE n."row" = least(greatest(a."row" + i, 0), 127) AND n.col = least(greatest(a.col + j, 0), 127)) GROUP BY 1, 2""",
)
def percentiles(t: Tables) -> DataFrame:
    """Around every cell."""
    band = t.dem.withColumn("value", F.round("value", 6))
    out = raster.box_percentiles(band, t.dem, 50, SIDE, SIDE, [0.1, 0.5, 0.9])
    return out.select("row", "col", *[F.get("p", i).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


_GRAD = """CASE WHEN {b} IS NOT NULL AND {a} IS NOT NULL THEN ({a} - {b}) / 160.0 ELSE coalesce(({a} - dem) / 80.0, (dem - {b}) / 80.0, 0.0) END"""


def _lag(part: str, order: str) -> str:
    return _GRAD.format(b=f"lag(dem) OVER (PARTITION BY {part} ORDER BY {order})", a=f"lead(dem) OVER (PARTITION BY {part} ORDER BY {order})")


@query("win8_mth10_gradient", f"""SELECT "row", col, round(100 * sqrt(gx * gx + gy * gy), 6) AS slope FROM (SELECT "row", col, {_lag('"row"', "col")} AS gx, {_lag("col", '"row"')} AS gy FROM cells)""")
def slope(t: Tables) -> DataFrame:
    d = raster.gradient(t.dem, 80.0, 80.0)
    return d.select("row", "col", R6(100 * g.hypot(F.col("gx"), F.col("gy")), "slope"))


@query(
    "win9_local_maxima",
    """SELECT c."row", c.col, c.value FROM cells c WHERE c.value >= ALL (SELECT n.value FROM cells n WHERE abs(n."row" - c."row") <= 5 AND abs(n.col - c.col) <= 5)""".replace(
        "c.value >= ALL (SELECT n.value", "c.value = (SELECT max(n.value)"
    ),
)
def local_maxima(t: Tables) -> DataFrame:
    return raster.local_maxima(t.cells.select("row", "col", "value"), 5)


_W = raster.gaussian_weights(1.5)
_WV = "(VALUES " + ", ".join(f"({i - len(_W) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(_W)) + ")"


@query(
    "win10_gaussian",
    f"""SELECT CAST(c."row" + a.d AS INTEGER) AS "row", CAST(c.col + b.d AS INTEGER) AS col, round(sum(c.value * a.w * b.w), 5) AS value
        FROM cells c, {_WV} AS a(d, w), {_WV} AS b(d, w) WHERE c."row" + a.d BETWEEN 0 AND 127 AND c.col + b.d BETWEEN 0 AND 127 GROUP BY 1, 2""",
)
def gaussian(t: Tables) -> DataFrame:
    return raster.smooth(t.cells, 1.5, SIDE, SIDE).select("row", "col", F.round("value", 5).alias("value"))


@query(
    "win11_fill_nearest",
    """WITH v AS (SELECT "row", col, round(disc, 9) AS value FROM cells WHERE ("row" + col) % 37 <> 0), m AS (SELECT "row", col FROM cells WHERE ("row" + col) % 37 = 0)
       SELECT * FROM v UNION ALL SELECT m."row", m.col, (min({'d': (v."row" - m."row") * (v."row" - m."row") + (v.col - m.col) * (v.col - m.col), 'r': v."row", 'c': v.col, 'v': v.value})).v
       FROM m JOIN v ON abs(v."row" - m."row") <= 24 AND abs(v.col - m.col) <= 24 GROUP BY m."row", m.col""",
)
def fill(t: Tables) -> DataFrame:
    return raster.fill_nearest(t.ndvi.withColumn("value", F.round("value", 9)))


@query(
    "agg14_weighted_centroid",
    'SELECT round(sum(value * (col * 80.0 + 40)) / sum(value), 6) AS x, round(sum(value * (10240 - "row" * 80.0 - 40)) / sum(value), 6) AS y FROM cells',
)
def centroid(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.cells.agg(R6(F.sum(v * (F.col("col") * 80.0 + 40)) / F.sum(v), "x"), R6(F.sum(v * (10240 - F.col("row") * 80.0 - 40)) / F.sum(v), "y"))


@query("agg15_block_sum", 'SELECT CAST("row" // 3 AS INTEGER) AS "row", CAST(col // 3 AS INTEGER) AS col, sum(value) AS value FROM cells WHERE "row" < 126 AND col < 126 GROUP BY 1, 2')
def block_sum(t: Tables) -> DataFrame:
    return raster.block_sum(t.cells, 3, SIDE, SIDE)


@query(
    "jn17_sample",
    'SELECT id, value, coalesce(value, 0) >= (SELECT quantile_cont(value, 0.9) FROM cells WHERE value > 0) AS core FROM segments LEFT JOIN cells ON col = floor(x0 / 80.0) AND "row" = floor((y0 - 10240.0) / -80.0)',
)
def sample(t: Tables) -> DataFrame:
    q = quantiles(t.cells.where("value > 0"), "value", [0.9]).select(F.get("q", 0).alias("q"))
    points = t.segments.select("id", F.col("x0").alias("px"), F.col("y0").alias("py"))
    out = raster.sample(points, t.cells, AFFINE).crossJoin(F.broadcast(q))
    return out.select("id", "value", (F.coalesce("value", F.lit(0.0)) >= F.col("q")).alias("core"))


@query(
    "jn18_sample3",
    """SELECT id, round(avg(dem), 6) AS value FROM (SELECT id, unnest([x0, (x0 + x1) / 2.0, x1]) AS px, unnest([y0, (y0 + y1) / 2.0, y1]) AS py FROM segments)
       LEFT JOIN cells ON col = floor(px / 80.0) AND "row" = floor((py - 10240.0) / -80.0) GROUP BY id""",
)
def sample3(t: Tables) -> DataFrame:
    return raster.sample3(t.segments, t.dem, AFFINE).select("id", R6(F.col("value"), "value"))


@query(
    "mth11_12_relative_elevation",
    """SELECT id, round(coalesce(c.dem - m.mean, 0.0), 5) AS rel FROM segments LEFT JOIN cells c ON col = floor(x0 / 80.0) AND "row" = floor((y0 - 10240.0) / -80.0)
       LEFT JOIN (SELECT "row" - i AS r, col - j AS k, avg(dem) AS mean FROM cells, """
    + _offsets_sql(raster.disk_offsets(500, 80, 80, False))
    + """ GROUP BY 1, 2) m ON m.r = c."row" AND m.k = c.col""",
)
def relative_elevation(t: Tables) -> DataFrame:
    mean = raster.disk_mean_std(t.dem, 500, 80, 80, SIDE, SIDE).select("row", "col", "mean")
    both = t.dem.join(mean, ["row", "col"], "left").select("row", "col", (F.col("value") - F.col("mean")).alias("value"))
    points = t.segments.select("id", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return raster.sample(points, both, AFFINE).select("id", F.round(F.coalesce("value", F.lit(0.0)), 5).alias("rel"))


@query("src6_ras2_crop", 'SELECT "row", col, value FROM cells WHERE "row" BETWEEN 65 AND 103 AND col BETWEEN 25 AND 62')
def crop(t: Tables) -> DataFrame:
    return raster.crop(t.cells.select("row", "col", "value"), AFFINE, 2000, 2000, 5000, 5000)


@query("ras1_4_rasterize", f'SELECT "row", col FROM cells WHERE {_inside_sql("(col * 80.0 + 40)", chr(40) + "10240 - " + chr(34) + "row" + chr(34) + " * 80.0 - 40)")}')
def rasterize(t: Tables) -> DataFrame:
    grid = t.cells.select("row", "col", (F.col("col") * 80.0 + 40).alias("x"), (10240 - F.col("row") * 80.0 - 40).alias("y"))
    assert len(BOUNDARY) > 3
    return raster.rasterize(grid, boundary()).select("row", "col")


@query("ras5_clean_band", 'SELECT "row", col, CASE WHEN (row + col) % 11 = 0 OR value < 60 THEN 0.0 ELSE value - 60 END AS value FROM cells'.replace("(row", '("row"'))
def clean(t: Tables) -> DataFrame:
    band = t.cells.select("row", "col", F.when((F.col("row") + F.col("col")) % 11 == 0, -99999.0).otherwise(F.col("value") - 60).alias("value"))
    return raster.clean_band(band)


@query(
    "ras3_resample_nearest",
    """SELECT g.r AS "row", g.k AS col, c.value FROM (SELECT CAST(r AS INTEGER) AS r, CAST(k AS INTEGER) AS k FROM (SELECT unnest(range(100)) AS r), (SELECT unnest(range(100)) AS k)) g
       LEFT JOIN cells c ON c.col = floor((g.k * 100.0 + 50) / 80.0) AND c."row" = floor((10240 - g.r * 100.0 - 50 - 10240) / -80.0)""",
)
def nearest(t: Tables) -> DataFrame:
    grid = t.spark.range(100 * 100).select(F.floor(F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    grid = grid.withColumns({"x": F.col("col") * 100.0 + 50, "y": 10240 - F.col("row") * 100.0 - 50})
    return raster.resample(t.cells, grid, AFFINE)


@query(
    "ras3_resample_sum",
    'SELECT CAST("row" // 2 AS INTEGER) AS "row", CAST(col // 2 AS INTEGER) AS col, round(sum(value), 6) AS value FROM cells GROUP BY 1, 2',
)
def sum_up(t: Tables) -> DataFrame:
    a, c, e, f = AFFINE
    out = raster.resample_sum(t.cells, AFFINE, (2 * a, c, 2 * e, f)).where("value > 0")
    return out.select("row", "col", R6(F.col("value"), "value"))
