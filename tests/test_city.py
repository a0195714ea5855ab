"""A small made-up city from files to predictions."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.functions import utm
from kerbline.operators import gnn
from kerbline.plans import features
from kerbline.plans.city import City
from kerbline.sources import rasters
from kerbline.sources.weights import Checkpoint, dump, load

LON, LAT, STEP = 9.0, 45.0, 0.002


def test_tiff_round_trip_and_deflate():
    v = np.arange(12.0).reshape(3, 4)
    v[1, 1] = -7
    band = rasters.read_tiff(rasters.write_tiff(rasters.Band(v, (30.0, 500.0, -30.0, 900.0), -7.0)))
    assert (band.values == v).all() and band.affine == (30.0, 500.0, -30.0, 900.0) and band.nodata == -7
    flat = np.array([[1, 2, 4], [7, 7, 9]], "<u2")
    diff = np.concatenate((flat[:, :1], np.diff(flat, axis=1)), axis=1).astype("<u2")
    body = zlib.compress(diff.tobytes())
    tags = [(256, 3), (257, 2), (258, 16), (259, 8), (273, 8), (278, 2), (279, len(body)), (317, 2)]
    head = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, x) for t, x in tags) + struct.pack("<I", 0)
    got = rasters.read_tiff(b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + head)
    assert (got.values == flat).all()


@pytest.fixture(scope="module")
def city(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cities")
    folder = base / "Old_Town" / "input"
    (folder / "buildings").mkdir(parents=True)
    rng = random.Random(1)
    at = lambda i, j: [LON + i * STEP, LAT + j * STEP]
    kinds = ["residential", "primary_link", "footway", "unclassified"]
    lines = [[at(i, j), at(i + 1, j)] for i in range(4) for j in range(5)] + [[at(i, j), [at(i, j)[0] + 1e-4, at(i, j)[1] + STEP / 2], at(i, j + 1)] for i in range(5) for j in range(4)]
    feats = [{"type": "Feature", "properties": {"highway": kinds[k % 4]}, "geometry": {"type": "LineString", "coordinates": c}} for k, c in enumerate(lines)]
    (folder / "roads.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    edge = [(LON - STEP, LAT - STEP), (LON + 5 * STEP, LAT - STEP), (LON + 5 * STEP, LAT + 5 * STEP), (LON - STEP, LAT + 5 * STEP), (LON - STEP, LAT - STEP)]
    (folder / "boundary.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [edge]}}]}))
    made = City.from_file(spark, str(base), "Old Town")
    p = spark.range(1).select(utm.forward(F.lit(LON), F.lit(LAT), F.lit(made.zone)).alias("p")).first()["p"]
    noise = np.random.default_rng(2)
    for name, res, values in (
        ("population.tif", 100.0, noise.integers(0, 50, (16, 16))), ("dem.tif", 50.0, noise.normal(100, 5, (32, 32))), ("cover1.tif", 60.0, noise.choice([10, 20, 50, 80], (26, 26))), ("ndvi.tif", 50.0, noise.random((32, 32))),
    ):
        v = values.astype(float)
        v[3, 3] = rasters.NODATA
        (folder / name).write_bytes(rasters.write_tiff(rasters.Band(v, (res, p["x"] - 400, -res, p["y"] + 1200), rasters.NODATA)))
    shapes = b""
    table = b""
    for n in range(12):
        x, y = LON + rng.random() * 4 * STEP, LAT + rng.random() * 4 * STEP
        table += b" " + str(n + 3).rjust(6).encode() + b"x" * 4
        ring = [(x, y), (x, y + 2e-4), (x + 2e-4, y + 2e-4), (x + 2e-4, y), (x, y)]
        body = struct.pack("<i4d2i", 5, x, y, x + 2e-4, y + 2e-4, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *q) for q in ring)
        shapes += struct.pack(">2i", n + 1, len(body) // 2) + body
    (folder / "buildings" / "a.shp").write_bytes(b"\0" * 100 + shapes)
    field = lambda name, width: name.encode().ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    names = field("Floors", 6) + field("note", 4) + b"\x0d"
    (folder / "buildings" / "a.dbf").write_bytes(b"\x03\x18\x01\x01" + struct.pack("<IHH", 12, 32 + len(names), 11) + b"\0" * 20 + names + table)
    rows = [(str(i), (f"n{i}",), (None,), (["shopping", "bar"] if i % 2 else None,), (LON + rng.random() * 4 * STEP, LAT + rng.random() * 4 * STEP)) for i in range(60)]
    kinds = "id string, names struct<primary:string>, categories struct<primary:string>, taxonomy struct<hierarchy:array<string>>, bbox struct<xmin:double,ymin:double>, geometry binary"
    rows = [(*r, struct.pack("<BI2d", 1, 1, *r[4])) for r in rows]
    spark.createDataFrame(rows, kinds).write.parquet(str(folder / "places.parquet"))
    return made


def test_city(spark, city, tmp_path):
    segs = city.segments()
    assert segs.count() == 30 and {r.highway for r in segs.collect()} == {"residential", "primary", "footway"}
    assert segs.select(F.sum(F.size("coords"))).first()[0] > 60
    for step in (city.network_features, city.population_features, city.terrain_features, city.urban_features, city.building_features, city.land_cover_features, city.place_features):
        step()
    table = city.feature_table()
    assert table.count() == 30 and len(table.columns) == 205 and len(set(table.columns)) == 205
    row = table.agg(*[F.max(c).alias(c) for c in ("net_betweenness_seg_val", "poi_l1_shopping_buf200_density", "bldg_far_buf500_val", "green_ndvi_buf200_mean", "pop_pop_density_buf500_density")]).first()
    assert row[0] == 1 and all(v > 0 for v in row)
    shares = table.select(sum((F.col(f"lc_wc_{n}_buf200_ratio") for n in list(features.COVER.values())[1:]), F.col("lc_wc_tree_buf200_ratio")).alias("s")).collect()
    assert all(0.9 < r.s <= 1 + 1e-9 for r in shares)
    names = ["net_betweenness_seg_val", "net_closeness_seg_val", *[c for c in table.columns if c.startswith("net_rt_")]]
    model = Checkpoint(gnn.random_weights(len(names) + 3, 8, 1, seed=4), names, {"layers": 1, "walk": 3, "dropout": 0.3}, {names[0]: [0.0, 0.5, 1.0]})
    (tmp_path / "m.npz").write_bytes(dump(model))
    out = city.predict(load(spark, f"{tmp_path}/m.npz"), runs=4).collect()
    assert len(out) == 30 and {0.0, 1.0} <= {r.pred_density for r in out} and any(r.pred_uncertainty > 0 for r in out)
    city.write_geojson()
    lines = [json.loads(r.value) for r in spark.read.text(city.table("predictions.geojson")).collect()]
    first = lines[0]["geometry"]["coordinates"][0]
    assert len(lines) == 30 and abs(first[0] - LON) < 0.02 and abs(first[1] - LAT) < 0.02


def test_tiles_and_degrees(spark, city, tmp_path):
    """Two adjacent tiles become one raster; counts in degrees keep their sum in metres, classes their nearest cell."""
    left, right = np.arange(6.0).reshape(2, 3), np.arange(6.0, 12.0).reshape(2, 3)
    folder = __import__("pathlib").Path(city.source(""))
    (folder / "t1.tif").write_bytes(rasters.write_tiff(rasters.Band(left, (10.0, 0.0, -10.0, 100.0), -1.0)))
    (folder / "t2.tif").write_bytes(rasters.write_tiff(rasters.Band(right, (10.0, 20.0, -10.0, 90.0), -1.0)))
    cells, affine, height, width = city._raster("t?.tif")
    got = {(r.row, r.col): r.value for r in cells.collect()}
    want = {(r + 1, c + 2): right[r, c] for r in range(2) for c in range(3)} | {(r, c): left[r, c] for r in range(2) for c in range(3)}
    assert got == want and affine == (10.0, 0.0, -10.0, 100.0) and (height, width) == (3, 5)
    flat = np.random.default_rng(3).integers(1, 9, (20, 20)).astype(float)
    band = rasters.Band(flat, (0.0008, LON - 0.004, -0.0008, LAT + 0.012), -1.0, True)
    (folder / "deg.tif").write_bytes(rasters.write_tiff(band))
    assert rasters.read_tiff(rasters.write_tiff(band)).degrees
    shared, grid, tall, wide = city._raster("deg.tif", "sum", 100.0)
    assert sum(r.value for r in shared.collect()) == pytest.approx(flat.sum(), rel=0.02)
    near, grid, tall, wide = city._raster("deg.tif", "nearest", 100.0)
    for r in near.where("value is not null").limit(50).collect():
        p = spark.range(1).select(utm.inverse(F.lit(grid[1] + (r.col + 0.5) * 100), F.lit(grid[3] - (r.row + 0.5) * 100), F.lit(city.zone)).alias("p")).first()["p"] if r.row % 7 == 0 else None
        if p:
            assert r.value == flat[int((LAT + 0.012 - p["lat"]) / 0.0008), int((p["lon"] - LON + 0.004) / 0.0008)]
