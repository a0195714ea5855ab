"""Lines and the points near them, brought together by tile.

A line is in one tile, that of the middle of its box; a point is copied to every tile whose lines it can reach. So the long table
is shuffled once, as one row a line, and what is found for a line is found in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.gridjoin import cells
from kerbline.runtime import materialize

#: Lines of a tile in one place; a crowded tile has several.
LINES_A_PLACE = 1 << 17
#: A tile is so many times as wide as its lines reach.
WIDE = 3.0

Near = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _box(legs: Column) -> tuple[Column, ...]:
    ends = lambda f, g, a: f(F.transform(legs, lambda p: g(p[f"{a}0"], p[f"{a}1"])))
    low, high = (F.array_min, F.least), (F.array_max, F.greatest)
    return ends(*low, "x"), ends(*high, "x"), ends(*low, "y"), ends(*high, "y")


def by_tile(lines: DataFrame, points: DataFrame, r: float, near: Near, schema: str, most_points: int | None = None) -> tuple[DataFrame, bool]:
    """``near(ids, count, v, points)`` of every tile, and whether a line can come out more than once.

    ``lines(id, legs, v)`` with ``v`` an array of doubles that the function gets, and ``points(px, py, v)`` likewise, or boxes with ``(qx, qy)`` too: lines as ids,
    lengths of their arrays and these one after the other, points as a matrix. Lines are kept in classes by the size of their box,
    so that a long one does not widen the reach of all. A tile with more than ``most_points`` points, if that is given, is dealt
    over several places that its lines all visit; otherwise a task holds the points of a tile.
    """
    x0, x1, y0, y1 = _box(F.col("legs"))
    line = lines.select(F.col("id").cast("long").alias("id"), "v", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    line = line.withColumn("k", F.greatest(F.ceil(F.log(8.0, F.greatest(half * 8 / r, F.lit(1e-9)))), F.lit(0)).cast("int"))
    side = WIDE * (r + r / 8 * F.pow(F.lit(8.0), F.col("k")))
    at = lambda a: F.floor((F.col(f"{a}0") + F.col(f"{a}1")) / 2 / side).cast("int")
    line = line.select("id", "v", "k", at("x").alias("cx"), at("y").alias("cy")).where("cx is not null and cy is not null")
    key = ["k", "cx", "cy"]
    sizes = materialize(line.groupBy(*key).agg(F.ceil(F.count("*") / LINES_A_PLACE).cast("int").alias("parts")), "tiles")
    copies = None
    for k in sorted(row["k"] for row in sizes.select("k").distinct().collect()):
        reach = (r + r / 8 * 8.0**k) * (1 + 1e-9)
        px, py = F.col("px"), F.col("py")
        qx, qy = (F.col("qx"), F.col("qy")) if "qx" in points.columns else (px, py)
        some = points.select("v", F.lit(k).alias("k"), F.inline(cells(px - reach, py - reach, qx + reach, qy + reach, WIDE * (r + r / 8 * 8.0**k))))
        copies = some if copies is None else copies.unionByName(some)
    if copies is None:
        copies = points.select("v", F.lit(0).alias("k"), F.lit(0).alias("cx"), F.lit(0).alias("cy")).where("false")
    several = False
    sizes = sizes.withColumn("places", F.lit(1))
    if most_points is not None:
        places = copies.groupBy(*key).agg(F.ceil(F.count("*") / most_points).cast("int").alias("places"))
        sizes = materialize(sizes.drop("places").join(places, key, "left").withColumn("places", F.coalesce("places", F.lit(1))), "places")
        several = (sizes.agg(F.max("places")).first()[0] or 1) > 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = line.join(sizes, key).select(*key, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), every("places").alias("place"), F.lit(1).alias("tag"), "id", "v")
    right = copies.join(sizes, key).withColumn("place", F.pmod(F.monotonically_increasing_id(), F.col("places")).cast("int"))
    right = right.select(*key, every("parts").alias("part"), "place", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("id"), "v")
    key += ["part", "place"]
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = right.unionByName(left).repartition(tasks, *key).sortWithinPartitions(*key, "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if held[1]:
                ids = np.concatenate([i for i, _ in held[1]])
                v = pa.chunked_array([c for _, c in held[1]]).combine_chunks()
                count = np.diff(v.offsets.to_numpy())
                p = pa.chunked_array([c for c in held[0]]).combine_chunks() if held[0] else None
                p = np.zeros((0, 2)) if p is None else p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
                yield from near(ids, count, v.flatten().to_numpy(zero_copy_only=False), p)

        for b in batches:
            where = [b.column(i).to_numpy() for i in range(6)]
            change = np.flatnonzero(np.logical_or.reduce([np.diff(w) != 0 for w in where])) + 1
            for a, z in zip([0, *change], [*change, len(b)]):
                if a == z:
                    continue
                here = tuple(int(w[a]) for w in where[:5])
                if here != now:
                    yield from done()
                    now, held = here, ([], [])
                v = b.column(7).slice(a, z - a)
                if where[5][a] == 0:
                    held[0].append(v)
                else:
                    held[1].append((b.column(6).slice(a, z - a).to_numpy(), v))
        yield from done()

    return both.mapInArrow(run, schema), several


def blocks(x: np.ndarray, y: np.ndarray, side: float) -> Iterator[np.ndarray]:
    """Positions of places that lie in one square of the given side."""
    cx, cy = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
    order = np.lexsort((cx, cy))
    cut = np.flatnonzero((np.diff(cx[order]) != 0) | (np.diff(cy[order]) != 0)) + 1
    yield from np.split(order, cut)
