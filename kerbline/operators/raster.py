"""Raster bands as cell tables ``(row, col, value)``: kernels, windows, resampling and sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geometry import in_polygon
from kerbline.runtime import materialize


def disk_offsets(radius: float, xres: float, yres: float | None = None, by_cell: bool = True) -> list[tuple[int, int]]:
    """``(row, col)`` offsets of a disk: within ceil(radius / xres) cells, or within the radius in metres."""
    yres = yres or xres
    if by_cell:
        rc = max(1, math.ceil(radius / xres))
        return [(i, j) for i in range(-rc, rc + 1) for j in range(-rc, rc + 1) if i * i + j * j <= rc * rc]
    ni, nj = int(radius // yres), int(radius // xres)
    return [(i, j) for i in range(-ni, ni + 1) for j in range(-nj, nj + 1) if (i * yres) ** 2 + (j * xres) ** 2 <= radius**2]


def box_side(radius: float, res: float = 30.0) -> int:
    return 2 * math.ceil(radius / res) + 1


def kernel_sums(cells: DataFrame, offsets: list[tuple[int, int]], sums: dict[str, Column], inside: Column | None = None) -> DataFrame:
    """Scatter form of a convolution with ones: each cell is added to all cells at an offset; one shuffle and no join.

    Partial aggregation collapses the copies before the shuffle. ``inside`` filters the target cells.
    """
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    spread = cells.select("row", "col", *[v.alias(k) for k, v in sums.items()], F.inline(moves))
    out = spread.select((F.col("row") - F.col("i")).alias("row"), (F.col("col") - F.col("j")).alias("col"), *sums)
    out = out.groupBy("row", "col").agg(*[F.sum(k).alias(k) for k in sums])
    return out if inside is None else out.where(inside)


def disk_sum(cells: DataFrame, radius: float, res: float, height: int, width: int) -> DataFrame:
    """``(row, col, s)`` over all cells of the raster that a kernel reaches."""
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return kernel_sums(cells, disk_offsets(radius, res), {"s": F.col("value")}, inside)


def disk_mean_std(cells: DataFrame, radius: float, xres: float, yres: float, height: int, width: int) -> DataFrame:
    """Mean and population deviation of the valid cells within a metric disk."""
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    v = F.col("value").cast("double")
    out = kernel_sums(cells.where("value is not null"), disk_offsets(radius, xres, yres, False), {"n": F.lit(1), "s": v, "q": v * v}, inside)
    mean = F.col("s") / F.col("n")
    return out.select("row", "col", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def pad_nearest(cells: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """The raster with its border cells repeated k times outwards."""

    def copies(c: str, n: int) -> Column:
        low = F.sequence(F.lit(-k), F.lit(0))
        high = F.sequence(F.lit(n - 1), F.lit(n - 1 + k))
        only = F.sequence(F.lit(-k), F.lit(k))
        return F.when((F.col(c) == 0) & (n == 1), only).when(F.col(c) == 0, low).when(F.col(c) == n - 1, high).otherwise(F.array(F.col(c)))

    out = cells.withColumn("row", F.explode(copies("row", height)))
    return out.withColumn("col", F.explode(copies("col", width)))


def _box(df: DataFrame, k: int, agg: dict[str, Column], again: dict[str, Column]) -> DataFrame:
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-k, k)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-k, k)
    once = df.select("row", "col", *[v.over(along).alias(n) for n, v in agg.items()])
    return once.select("row", "col", *[v.over(down).alias(n) for n, v in again.items()])


def box_mean_std(cells: DataFrame, radius: float, height: int, width: int, res: float = 30.0) -> DataFrame:
    """Mean and deviation on a square window with repeated borders, by two passes of window sums over a full raster."""
    k = (box_side(radius, res) - 1) // 2
    padded = pad_nearest(cells.select("row", "col", F.col("value").cast("double").alias("value")), k, height, width)
    v = F.col("value")
    out = _box(padded, k, {"s": F.sum(v), "q": F.sum(v * v), "n": F.count(v)}, {"s": F.sum("s"), "q": F.sum("q"), "n": F.sum("n")})
    mean = F.col("s") / F.col("n")
    out = out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return out.select("row", "col", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def box_percentiles(cells: DataFrame, at: DataFrame, radius: float, height: int, width: int, qs: list[float], res: float = 30.0) -> DataFrame:
    """Percentiles of the square window around the cells ``at(row, col)`` only, borders repeated; column ``p`` is an array."""
    k = (box_side(radius, res) - 1) // 2
    moves = F.sequence(F.lit(-k), F.lit(k))
    want = at.select("row", "col").distinct().withColumn("i", F.explode(moves)).withColumn("j", F.explode(moves))
    clamp = lambda c, d, n: F.least(F.greatest(F.col(c) + F.col(d), F.lit(0)), F.lit(n - 1))
    want = want.select("row", "col", clamp("row", "i", height).alias("r"), clamp("col", "j", width).alias("c"))
    src = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), "value")
    got = want.join(src, ["r", "c"]).groupBy("row", "col")
    listed = ", ".join(f"percentile_disc({q}) within group (order by value)" for q in qs)
    return got.agg(F.expr(f"array({listed})").alias("p"))


def gradient(cells: DataFrame, xres: float, yres: float) -> DataFrame:
    """``(row, col, gx, gy)`` of a full raster: central differences, one-sided at the borders."""

    def along(part: str, order: str, step: float) -> Column:
        w = Window.partitionBy(part).orderBy(order)
        before, after, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
        one = F.coalesce((after - v) / step, (v - before) / step, F.lit(0.0))
        return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * step)).otherwise(one)

    return cells.select("row", "col", along("row", "col", xres).alias("gx"), along("col", "row", yres).alias("gy"))


def local_maxima(cells: DataFrame, k: int = 10) -> DataFrame:
    """Cells that hold the greatest value of the (2k+1)-square around them; cells may be missing.

    Separable: a scatter over the rows, collapsed before the shuffle, then window maxima along each row.
    """
    moves = F.explode(F.sequence(F.col("row") - k, F.col("row") + k)).alias("row")
    tall = cells.select("col", "value", moves).groupBy("row", "col").agg(F.max("value").alias("m"))
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-k, k)
    top = tall.select("row", "col", F.max("m").over(along).alias("m"))
    return cells.join(top, ["row", "col"]).where("value = m").drop("m")


def gaussian_weights(sigma: float) -> list[float]:
    n = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-n, n + 1)]
    return [w / sum(raw) for w in raw]


def smooth(cells: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """Gaussian smoothing, zero outside; two passes of a weighted scatter."""
    weights = gaussian_weights(sigma)
    n = len(weights) // 2
    moves = F.array(*[F.struct(F.lit(i - n).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(weights)])
    out = cells.select("row", "col", F.col("value").cast("double").alias("value"))
    for c, size, other in (("row", height, "col"), ("col", width, "row")):
        spread = out.select(other, c, "value", F.inline(moves)).select(other, (F.col(c) + F.col("d")).alias(c), (F.col("value") * F.col("w")).alias("value"))
        out = spread.where(F.col(c).between(0, size - 1)).groupBy("row", "col").agg(F.sum("value").alias("value"))
    return out


def block_sum(cells: DataFrame, f: int, height: int, width: int) -> DataFrame:
    """f x f sums; a trailing remainder of rows or columns is trimmed."""
    kept = cells.where((F.col("row") < height // f * f) & (F.col("col") < width // f * f))
    at = [F.floor(F.col(c) / f).cast("int").alias(c) for c in ("row", "col")]
    return kept.groupBy(*at).agg(F.sum("value").alias("value"))


def fill_nearest(cells: DataFrame) -> DataFrame:
    """Null cells take the value of the nearest valid cell; ties to the smaller row, then column. Rings double until found."""
    valid, out = cells.where("value is not null"), None
    waiting = materialize(cells.where("value is null").select("row", "col"), "waiting")
    out, reach, before = valid.select("row", "col", "value"), 2, 0
    if valid.isEmpty():
        return cells
    while not waiting.isEmpty():
        moves = F.sequence(F.lit(-reach), F.lit(reach))
        want = waiting.withColumn("i", F.explode(moves)).withColumn("j", F.explode(moves))
        want = want.where(f"i * i + j * j <= {reach * reach} and i * i + j * j > {before * before}")
        near = want.join(
            valid.select((F.col("row")).alias("r"), F.col("col").alias("c"), "value"), (F.col("r") == F.col("row") + F.col("i")) & (F.col("c") == F.col("col") + F.col("j"))
        )
        best = near.groupBy("row", "col").agg(F.min(F.struct((F.col("i") ** 2 + F.col("j") ** 2).alias("d"), "r", "c", "value")).alias("b"))
        found = materialize(best.select("row", "col", F.col("b.value").alias("value")), "filled")
        out = out.unionByName(found)
        waiting = materialize(waiting.join(found, ["row", "col"], "left_anti"), "waiting")
        reach, before = 2 * reach, reach
    return out


def sample(points: DataFrame, cells: DataFrame, affine: tuple[float, float, float, float], name: str = "value") -> DataFrame:
    """The value under each point ``(.., px, py)``, null outside; affine is (a, c, e, f) with x = c + a col, y = f + e row."""
    a, c, e, f = affine
    at = points.withColumns({"col": F.floor((F.col("px") - c) / a).cast("int"), "row": F.floor((F.col("py") - f) / e).cast("int")})
    return at.join(cells.select("row", "col", F.col("value").alias(name)), ["row", "col"], "left").drop("row", "col")


def sample3(segments: DataFrame, cells: DataFrame, affine: tuple[float, float, float, float]) -> DataFrame:
    """``(id, value)``: mean of the values under start, middle and end, those outside clamped to the border by the caller."""
    x, y = [F.col("x0"), (F.col("x0") + F.col("x1")) / 2, F.col("x1")], [F.col("y0"), (F.col("y0") + F.col("y1")) / 2, F.col("y1")]
    three = F.array(*[F.struct(a.cast("double").alias("px"), b.cast("double").alias("py")) for a, b in zip(x, y)])
    return sample(segments.select("id", F.inline(three)), cells, affine).groupBy("id").agg(F.avg("value").alias("value"))


def common_grid(tiles: list[tuple[tuple[float, float, float, float], int, int]]) -> tuple[tuple[float, float, float, float], int, int, list[tuple[int, int]]]:
    """Affine, height and width of the grid that holds all tiles ``(affine, height, width)``, and each one's shift in rows and columns."""
    a, _, e, _ = tiles[0][0]
    if any(abs(t[0][0] - a) > 1e-6 * abs(a) or abs(t[0][2] - e) > 1e-6 * abs(e) for t in tiles):
        raise ValueError("tiles of unlike resolution")
    c, f = min(t[0][1] for t in tiles), max(t[0][3] for t in tiles)
    shifts = [(round((t[0][3] - f) / e), round((t[0][1] - c) / a)) for t in tiles]
    height, width = (max(s[k] + t[1 + k] for s, t in zip(shifts, tiles)) for k in (0, 1))
    return (a, c, e, f), height, width, shifts


def share_boxes(boxes: DataFrame, dst: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """``boxes(x0, y0, x1, y1, value)`` shared out to the cells of a grid by overlap area, so that sums are kept."""
    a, c, e, f = dst
    step = abs(e)
    at = lambda v, o, s: F.floor((v - o) / s)
    ends = {"c0": at(F.col("x0"), c, a), "c1": at(F.col("x1"), c, a), "r0": at(f - F.col("y1"), 0.0, step), "r1": at(f - F.col("y0"), 0.0, step)}
    wide = boxes.where("value is not null").withColumns(ends)
    out = wide.withColumn("col", F.explode(F.sequence("c0", "c1"))).withColumn("row", F.explode(F.sequence("r0", "r1")))
    left, top = c + F.col("col") * a, f - F.col("row") * step
    zero = F.lit(0.0)
    across = F.greatest(zero, F.least(F.col("x1"), left + a) - F.greatest(F.col("x0"), left)) / (F.col("x1") - F.col("x0"))
    down = F.greatest(zero, F.least(F.col("y1"), top) - F.greatest(F.col("y0"), top - step)) / (F.col("y1") - F.col("y0"))
    out = out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return out.groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.sum(F.col("value") * across * down).alias("value"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """``tiles(tile, row, col, value)``: the first tile with a value wins each cell."""
    first = tiles.where("value is not null").groupBy("row", "col").agg(F.min(F.struct("tile", "value")).alias("b"))
    return first.select("row", "col", F.col("b.value").alias("value"))


def resample(cells: DataFrame, grid: DataFrame, src: tuple[float, float, float, float], how: str = "nearest") -> DataFrame:
    """Values of the target cells ``grid(row, col, x, y)`` (centres in source coordinates): nearest or bilinear."""
    a, c, e, f = src
    u, v = (F.col("x") - c) / a - 0.5, (F.col("y") - f) / e - 0.5
    if how == "nearest":
        at = grid.withColumns({"sc": F.floor(u + 0.5).cast("int"), "sr": F.floor(v + 0.5).cast("int")})
        got = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
        return at.join(got, ["sr", "sc"], "left").select("row", "col", "value")
    four = [
        F.struct((F.floor(v) + i).cast("int").alias("sr"), (F.floor(u) + j).cast("int").alias("sc"), (abs_weight(u, j) * abs_weight(v, i)).alias("w"))
        for i in (0, 1)
        for j in (0, 1)
    ]
    at = grid.select("row", "col", F.inline(F.array(*four)))
    got = at.join(cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value"), ["sr", "sc"], "left").where("value is not null and w > 0")
    mean = got.groupBy("row", "col").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))
    return grid.select("row", "col").join(mean, ["row", "col"], "left")


def abs_weight(u: Column, j: int) -> Column:
    part = u - F.floor(u)
    return part if j else 1 - part


def resample_sum(cells: DataFrame, src: tuple[float, float, float, float], dst: tuple[float, float, float, float]) -> DataFrame:
    """Sums shared out by overlap area between axis-parallel grids (source cells no larger than targets)."""
    (a, c, e, f), (A, C, E, G) = src, dst
    x0, y0 = c + F.col("col") * a, f + F.col("row") * e
    lo = lambda p, o, s: F.floor((p - o) / s)
    ends = {"c0": lo(x0, C, A), "c1": lo(x0 + a, C, A), "r0": lo(y0, G, E), "r1": lo(y0 + e, G, E)}
    wide = cells.withColumns(ends)
    share = lambda p, size, o, s, k: F.greatest(F.lit(0.0), F.least((p + size - o) / s, k + 1) - F.greatest((p - o) / s, k)) / (size / s)
    out = wide.withColumn("tc", F.explode(F.sequence("c0", "c1"))).withColumn("tr", F.explode(F.sequence("r0", "r1")))
    w = share(x0, a, C, A, F.col("tc")) * share(y0, e, G, E, F.col("tr"))
    return out.groupBy(F.col("tr").cast("int").alias("row"), F.col("tc").cast("int").alias("col")).agg(F.sum(F.col("value") * w).alias("value"))


def rasterize(grid: DataFrame, rings: Column) -> DataFrame:
    """Cells ``(row, col, x, y)`` whose centre is in the polygon."""
    return grid.where(in_polygon(F.col("x"), F.col("y"), rings))


def class_band(cells: DataFrame, code: int) -> DataFrame:
    return cells.select("row", "col", F.coalesce((F.col("value") == code).cast("int"), F.lit(0)).alias("value"))


def crop(cells: DataFrame, affine: tuple[float, float, float, float], xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Cells that a box touches: a range filter on row and col, which prunes row groups of a sorted table."""
    a, c, e, f = affine
    rows = sorted((math.floor((ymin - f) / e), math.floor((ymax - f) / e)))
    cols = sorted((math.floor((xmin - c) / a), math.floor((xmax - c) / a)))
    return cells.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def clean_band(cells: DataFrame, nodata: float = -99999.0) -> DataFrame:
    """No data, non-finite and negative values become 0."""
    v = F.col("value").cast("double")
    bad = v.isNull() | F.isnan(v) | (v == nodata) | (F.abs(v) == float("inf")) | (v < 0)
    return cells.withColumn("value", F.when(bad, 0.0).otherwise(v))
