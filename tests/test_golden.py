"""Hand-made cases, brute force and round trips."""

import heapq
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.functions import geometry as g
from kerbline.functions import scalar as s
from kerbline.functions import utm
from kerbline.operators import gnn, graph, gridjoin, rangestats, rangesums, raster, relational
from kerbline.operators.components import connected_components
from kerbline.operators.rangesums import one_leg
from kerbline.sources import roads, sinks, vector
from kerbline.streaming.activity import windowed_counts


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def line(*points):
    return F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in points])


def test_polylines(spark):
    c = line((0, 0), (3, 0), (3, 4))
    row = one(spark, n=g.length(c), mid=g.midpoint(c), chord=g.chord(c), zero=g.length(line((1, 1), (1, 1))), bin=g.bearing_bin(F.lit(3), F.lit(4)), b=g.bounds(c))
    assert (row.n, row.mid.x, row.mid.y, row.chord, row.zero, row.bin) == (7, 3, 0.5, 5, 0, 10)
    assert tuple(row.b) == (0, 0, 3, 4)
    row = one(spark, s=g.straightness(F.lit(7.0), F.lit(5.0)), s0=g.straightness(F.lit(0.0), F.lit(0.0)), c0=g.circuity(F.lit(0.0), F.lit(0.0)))
    assert (row.s, row.s0, row.c0) == (5 / 7, 0, 1)


def test_polygons(spark):
    box = F.array(line((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), line((1, 1), (2, 1), (2, 2), (1, 2), (1, 1)))
    row = one(
        spark, area=g.polygon_area(box), p=g.polygon_perimeter(box), c=g.ring_centroid(box[0]), hole=g.in_polygon(F.lit(1.5), F.lit(1.5), box), inside=g.in_polygon(F.lit(3.0), F.lit(3.0), box),
        far=g.polygon_distance(F.lit(7.0), F.lit(8.0), box), edge=g.boundary_distance(F.lit(3.0), F.lit(3.5), box), unit=g.compactness(F.lit(1.0), F.lit(4.0)),
        within=g.line_within(line((2.5, 2.5), (3, 3)), box), crossing=g.line_within(line((3, 3), (9, 3), (3, 3.5)), box), cut=g.convex_overlap_area(box[0], line((2, 2), (9, 2), (9, 9), (2, 9), (2, 2))),
    )
    assert (row.area, row.p, row.c.x, row.c.y, row.hole, row.inside) == (15, 20, 2, 2, False, True)
    assert (row.far, row.edge, row.unit, row.within, row.crossing, row.cut) == (5, 0.5, math.pi / 4, True, False, 4)


def test_utm(spark):
    row = one(spark, p=utm.forward(F.lit(9.0), F.lit(0.0), F.lit(32)), z=utm.zone(F.lit(-73.9)), q=utm.forward(F.lit(-73.98), F.lit(40.75), F.lit(18)))
    assert (round(row.p.x, 6), round(row.p.y, 6), row.z) == (500000, 0, 18)
    assert 580_000 < row.q.x < 590_000 and 4_505_000 < row.q.y < 4_520_000


def test_gini_entropy_codes(spark):
    d = spark.createDataFrame([(1, float(v)) for v in (3, 1, 4, 1, 5)] + [(2, 7.0), (3, -1.0), (3, 0.0)], "k int, v double")
    got = {r.k: r.g for r in d.groupBy("k").agg(s.gini(F.col("v")).alias("g")).collect()}
    assert got[1] == pytest.approx(0.3142857, abs=1e-6) and got[2] == got[3] == 0
    row = one(
        spark, e=s.entropy([F.lit(1.0), F.lit(3.0), F.lit(0.0)]), none=s.entropy([F.lit(0.0)]), a=s.road_class(F.lit("motorway_link")), b=s.road_class(F.lit("['footway', 'path']")), c=s.road_class(F.lit("unclassified")),
        code=s.vocabulary_code(F.lit(None).cast("string"), ("x", "y")), n=s.to_number(F.lit("x")), f=s.finite(F.lit(float("nan"))),
    )
    assert row.e == pytest.approx(0.5623351, abs=1e-6) and row.none == 0
    assert (row.a, row.b, row.c, row.code, row.n, row.f) == ("motorway", "footway", None, 2, None, 0)


def test_kernels():
    assert [len(raster.disk_offsets(r, 100)) for r in (50, 200, 500)] == [5, 13, 81]
    assert [raster.box_side(r) for r in (50, 200, 500)] == [5, 15, 35]


def test_grid_joins_match_brute_force(spark):
    rng = random.Random(1)
    segs = [(i, *(rng.randint(0, 300) for _ in range(4))) for i in range(40)] + [(99, 5, 5, 5, 5)]
    pts = [(i, rng.randint(-50, 350), rng.randint(-50, 350)) for i in range(150)]

    def d2(q, p):
        _, x0, y0, x1, y1 = q
        dx, dy = x1 - x0, y1 - y0
        t = 0 if dx == dy == 0 else max(0, min(1, ((p[1] - x0) * dx + (p[2] - y0) * dy) / (dx * dx + dy * dy)))
        return (p[1] - x0 - t * dx) ** 2 + (p[2] - y0 - t * dy) ** 2

    left, right = spark.createDataFrame(segs, "id long, x0 long, y0 long, x1 long, y1 long"), spark.createDataFrame(pts, "pid long, px long, py long")
    for r in (7, 30):
        got = gridjoin.range_join(left, right, r).select("id", "pid").collect()
        assert len(got) == len(set(got))
        assert {tuple(x) for x in got} == {(q[0], p[0]) for q in segs for p in pts if d2(q, p) <= r * r}
    near = gridjoin.nearest_join(right.withColumnRenamed("pid", "id"), left.select(F.col("id").alias("rid"), F.col("x0").alias("rx"), F.col("y0").alias("ry")), "id", 10.0)
    want = {p[0]: min(((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, q[0]) for q in segs) for p in pts}
    assert {r.id: (round(r.d**2), r.rid) for r in near.collect()} == want


def test_star_is_capped(spark):
    ends = spark.createDataFrame([(i, 0, i + 1) for i in range(25)], "id long, a long, b long")
    assert graph.segment_graph(ends).count() == 380


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_paths(edges, nodes):
    adj = {n: {} for n in nodes}
    for u, v, w in edges:
        adj[u][v] = adj[v][u] = w
    dist = {}
    for src in nodes:
        d, heap = {}, [(0.0, src)]
        while heap:
            x, n = heapq.heappop(heap)
            if n not in d:
                d[n] = x
                for m, w in adj[n].items():
                    heapq.heappush(heap, (x + w, m))
        dist[src] = d
    return adj, dist


def test_centralities(spark):
    rng = random.Random(3)
    edges = sorted({(a, b) for a, b in ((rng.randint(0, 11), rng.randint(0, 11)) for _ in range(26)) if a < b} | {(20, 21)})
    edges = [(a, b, float(rng.choice((1, 2, 3)))) for a, b in edges]
    nodes = sorted({n for e in edges for n in e[:2]})
    adj, dist = brute_paths(edges, nodes)

    def count(a, b, memo={}):
        if (a, b) not in memo:
            memo[a, b] = 1 if a == b else sum(count(a, m) for m, w in adj[b].items() if abs(dist[a].get(m, 1e9) + w - dist[a][b]) < 1e-9)
        return memo[a, b]

    n = len(nodes)
    want = {v: sum(count(a, v) * count(v, b) / count(a, b) for a in nodes for b in nodes if a != v != b and a != b and b in dist[a] and v in dist[a] and abs(dist[a][v] + dist[v][b] - dist[a][b]) < 1e-9) / ((n - 1) * (n - 2)) for v in nodes}
    d = spark.createDataFrame(edges, "u long, v long, w double")
    got = {r.node: r.score for r in graph.betweenness(d).collect()}
    assert got == pytest.approx(want)
    near = {r.node: r.score for r in graph.closeness(d).collect()}
    core = max((set(x) for x in dist.values()), key=len)
    assert near == pytest.approx({v: (len(core) - 1) / sum(dist[v].values()) if v in core else 0 for v in nodes})


def test_network_matches_a_dense_mirror(spark):
    rng = np.random.default_rng(0)
    n, x, w = 6, rng.normal(size=(6, 3)), gnn.random_weights(3, 4, 2, wide=5)
    edges = [(i, j) for i in range(n - 1) for j in range(n - 1) if i != j and (i + j) % 2]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "id long, x array<double>")

    def lin(v, k):
        return w[f"{k}.weight"] @ v + w.get(f"{k}.bias", 0)

    def bn(v, k):
        return (v - w[f"{k}.running_mean"]) / np.sqrt(w[f"{k}.running_var"] + 1e-5) * w[f"{k}.weight"] + w[f"{k}.bias"]

    h = [np.maximum(bn(lin(np.maximum(bn(lin(v, "encoder.net.0"), "encoder.net.1"), 0), "encoder.net.4"), "encoder.net.5"), 0) for v in x]
    for i in range(2):
        new = []
        for row in range(n):
            sent = [gnn.sigmoid(lin(np.maximum(lin(np.r_[h[row], h[col]], f"layers.{i}.gate.0"), 0), f"layers.{i}.gate.2")) * lin(h[col], f"layers.{i}.W") for a, col in edges if a == row]
            z = h[row] + (np.mean(sent, axis=0) if sent else 0)
            z = (z - z.mean()) / np.sqrt(z.var() + 1e-5) * w[f"layers.{i}.norm.weight"] + w[f"layers.{i}.norm.bias"]
            new.append(np.maximum(z, 0))
        h = new
    want = [float(lin(np.maximum(lin(v, "head.0"), 0), "head.3")[0]) for v in h]
    got = gnn.predict(nodes, spark.createDataFrame(edges, "src long, dst long"), w, 2, runs=3)
    rows = {(r.id, r.run): r.score for r in got.collect()}
    assert [rows[i, 0] for i in range(n)] == pytest.approx(want) and len(rows) == 4 * n
    assert len({round(rows[0, r], 12) for r in (1, 2, 3)}) > 1
    assert {r.id: r.score for r in gnn.uncertainty(got).collect()} == pytest.approx(dict(enumerate(want)))
    kept = gnn._kept(np.arange(2000), 5, 8, 1, 0.2)
    assert (kept[:, 0] == 1).all() and set(np.unique(kept[:, 1:])) == {0.0, 1.25} and abs(kept[:, 1:].mean() - 1) < 0.02


def test_scaler_with_repeated_quantiles(spark):
    d = spark.createDataFrame([(float(v), "k") for v in (-1, 0, 0.5, 1, 1.5, 2, 9)], "a double, other string")
    got = gnn.quantile_scale(d, {"a": [0.0, 1.0, 1.0, 1.0, 2.0]}).collect()
    assert [r.a for r in got] == [0, 0, 0.125, 0.5, 0.875, 1, 1] and got[0].other == "k"


def test_walks_match_matrix_powers(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 9, (40, 2))]
    p = np.zeros((9, 9))
    for a, b in edges:
        p[a, b] += 1
    p /= np.maximum(p.sum(1, keepdims=True), 1)
    got = graph.random_walk_returns(spark.createDataFrame(edges, "src long, dst long"), 5).collect()
    for r in got:
        assert list(r)[1:] == pytest.approx([np.linalg.matrix_power(p, k)[r.id, r.id] for k in range(1, 6)])
    assert {r.id for r in got} == {a for a, _ in edges}


def test_uniform_ranks_ties(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 5, 5, 5, 9)], "v double")
    got = sorted(r.q for r in gnn.uniform_ranks(d, "v", "q").collect())
    assert [round(q, 4) for q in got] == [0, 0.2143, 0.2143, 0.4286, 0.7143, 0.7143, 0.7143, 1]


def test_bilinear_and_numbers(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0)], "row int, col int, value double")
    grid = spark.createDataFrame([(0, 0, 1.0, -1.0), (0, 1, 0.5, -0.5), (9, 9, 50.0, 50.0)], "row int, col int, x double, y double")
    got = {(r.row, r.col): r.value for r in raster.resample(cells, grid, (1.0, 0.0, -1.0, 0.0), "bilinear").collect()}
    assert got == {(0, 0): 4, (0, 1): 1, (9, 9): None}
    d = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    assert [r.n for r in relational.number_rows(d, ["k"]).orderBy("k").collect()] == list(range(100))
    assert relational.first_column(["a", "Height"], vector.HEIGHT_COLUMNS) == "Height" and relational.drop_repeated_names(["a", "b", "a"]) == [0, 1]


def test_roads_geojson_csv(spark, tmp_path):
    raw = [(0, "residential", [(0.0, 0.0), (1.0, 0.0)]), (1, "primary", [(1.0, 0.0), (0.0, 0.0)]), (2, "unclassified", [(1.0, 0.0), (2.0, 0.0)]), (3, "steps", [(2.0, 0.0), (5.0, 0.0)])]
    d = spark.createDataFrame(raw, "ord int, highway string, coords array<struct<x:double,y:double>>")
    segs = roads.street_segments(d)
    assert [(r.id, r["from"], r.to, r.highway) for r in segs.orderBy("id").collect()] == [(0, 1, 2, "residential"), (1, 3, 4, "steps")]
    clipped = roads.street_segments(d, F.array(line((-1, -1), (3, -1), (3, 1), (-1, 1), (-1, -1))))
    assert [r.highway for r in clipped.collect()] == ["residential"]
    sinks.write_geojson(segs, f"{tmp_path}/g")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/g").collect()]
    (tmp_path / "all.geojson").write_text('{"type": "FeatureCollection", "features": [' + ",".join(lines) + "]}")
    back = vector.read_geojson(spark, f"{tmp_path}/all.geojson", "id: long, highway: string")
    assert sorted((r.id, r.highway, [tuple(c) for c in r.coords]) for r in back.collect()) == [(0, "residential", [(0, 0), (1, 0)]), (1, "steps", [(2, 0), (5, 0)])]
    sinks.write_feature_csv(segs.select("id", (F.col("id") / 3).alias("f")), f"{tmp_path}/f.csv")
    sinks.write_features(segs, f"{tmp_path}/f.parquet")
    (tmp_path / "x.csv").write_text("﻿name,v\na,1\n")
    tables = vector.read_csv_tables(spark, [f"{tmp_path}/x.csv", f"{tmp_path}/f.csv"])
    assert [sorted(r.f for r in t.collect()) for t in tables] == [[0, 0.333333]]


def test_shapefile_and_heights(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 2, 2, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    (tmp_path / "b.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, 4) + b"\5\0\0\0\0\0\0\0")
    rows = vector.read_shapefiles(spark, f"{tmp_path}/*.shp").orderBy("path").collect()
    assert [tuple(p) for p in rows[0].rings[0]] == ring and rows[1].rings is None
    d = spark.createDataFrame([("10",), ("x",), ("0",), ("20",)], "Height string")
    assert [r.height for r in vector.heights(d.withColumnRenamed("Height", "levels")).collect()] == [30, 45, 45, 60]
    assert [r.height for r in vector.heights(d).collect()] == [10, 15, 15, 20]
    assert vector.heights(spark.range(1)).first().height == 0
    names = "height Height HEIGHT bldg_h bldg_height H_m h_m h HGT max_h mean_h levels Levels floors Floors".split()
    assert list(vector.HEIGHT_COLUMNS) == names
    assert [relational.first_column(names[k:][::-1], vector.HEIGHT_COLUMNS) for k in range(len(names))] == names
    for name in ("h", "max_h", "Levels", "Floors"):
        assert vector.heights(spark.createDataFrame([("10",)], [name])).first()["height"] == (10 if "h" in name else 30)


def test_pushdown_and_extract(spark, tmp_path):
    rows = [("a", ("n",), ("p",), (["x", "y"],), (1.0, 2.0)), ("b", (None,), ("p",), (None,), (9.0, 9.0))]
    kinds = "id string, names struct<primary:string>, categories struct<primary:string>, taxonomy struct<hierarchy:array<string>>, bbox struct<xmin:double,ymin:double>, geometry binary"
    rows = [(*r, struct.pack("<BI2d", 1, 1, r[4][0] + 0.25, r[4][1] + 0.5)) for r in rows]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/p")
    d = vector.read_points(spark, f"{tmp_path}/p", 0, 0, 5, 5)
    assert "GreaterThanOrEqual(bbox.xmin,0.0)" in d._jdf.queryExecution().toString()
    assert [tuple(r) for r in vector.poi_extract(d).collect()] == [("n", "x", "y", 2.5, 1.25)]


def test_windowed_counts(spark):
    d = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "b")], "t string, event_type string")
    got = windowed_counts(d.withColumn("ts", F.to_timestamp("t"))).collect()
    assert sorted((r.start.hour, r.event_type, r.n) for r in got) == [(0, "a", 2), (1, "b", 1)]


def test_range_sums_match_brute_force(spark, monkeypatch):
    """Polylines and points without length, crowded cells in several places, distances at the limit."""
    from kerbline.operators import rangesums

    monkeypatch.setattr(rangesums, "POINTS", 40)
    monkeypatch.setattr(rangesums, "LINES", 7)
    rng = random.Random(9)
    lines = [(i, [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(rng.randint(2, 4))]) for i in range(60)] + [(60, [(5, 5), (5, 5)]), (61, [(9000, 9000), (9001, 9000)])]
    points = [(rng.randint(0, 300), rng.randint(0, 300), float(rng.randint(1, 5)), rng.randrange(3)) for _ in range(500)] + [(150, 150, 1.0, 1)] * 90
    d = spark.createDataFrame(lines, "id long, coords array<struct<x:double,y:double>>".replace("double", "int"))
    d = d.select("id", F.transform("coords", lambda c: F.struct(c["x"].cast("double").alias("x"), c["y"].cast("double").alias("y"))).alias("coords"))
    p = spark.createDataFrame(points, "px int, py int, v double, k int")
    got = {r["id"]: r.asDict() for r in rangesums.range_sums(d.select("id", rangesums.all_legs(F.col("coords")).alias("legs")), p, [10, 50], ["v"], {"k": 3}).collect()}

    def far2(x, y, a, b):
        size = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0, min(1, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / size)) if size else 0
        return (x - a[0] - t * (b[0] - a[0])) ** 2 + (y - a[1] - t * (b[1] - a[1])) ** 2

    for i, line_ in lines:
        want = {f"{n}_{r}": 0.0 for r in (10, 50) for n in ("v", "k_0", "k_1", "k_2")}
        for x, y, v, k in points:
            d2 = min(far2(x, y, a, b) for a, b in zip(line_, line_[1:]))
            for r in (10, 50):
                if d2 <= r * r + 1e-9:
                    want[f"v_{r}"] += v
                    want[f"k_{k}_{r}"] += 1
        if any(want.values()):
            assert {c: v for c, v in got[i].items() if c != "id"} == want
        else:
            assert i not in got


def test_range_sums_of_straight_lines_hand_on_and_keep_all(spark):
    """Dense points, many of them at one place, distances at the limit, lines in all directions and without length; every line has a row."""
    from kerbline.operators import rangesums

    rng = np.random.default_rng(3)
    ends = rng.integers(0, 120, (80, 4))
    ends[0], ends[1], ends[2], ends[3], ends[4] = (5, 5, 5, 5), (10, 7, 90, 7), (33, 80, 33, 2), (9000, 9000, 9001, 9000), (0, 0, 100, 100)
    points = np.concatenate((rng.integers(0, 120, (3000, 2)), np.tile([[60, 60]], (50, 1))))
    v, k = rng.integers(1, 9, len(points)), rng.integers(0, 3, len(points))
    lines = spark.createDataFrame([(i, *map(int, e)) for i, e in enumerate(ends)], "id long, x0 long, y0 long, x1 long, y1 long")
    p = spark.createDataFrame([(int(x), int(y), float(a), int(b)) for (x, y), a, b in zip(points, v, k)], "px long, py long, v double, k int")
    got = rangesums.range_sums(lines.select("id", rangesums.one_leg().alias("legs"), (F.col("id") * 2.0).alias("twice")), p, [10, 40], ["v"], {"k": 3}, keep=["twice"]).collect()
    assert sorted(r["id"] for r in got) == list(range(80))
    for r in got:
        d2 = rangesums.distance2(points[:, 0].astype(float), points[:, 1].astype(float), ends[r["id"]].astype(float))
        want = {"id": r["id"], "twice": r["id"] * 2.0}
        for q in (10, 40):
            want |= {f"v_{q}": v[d2 <= q * q].sum()} | {f"k_{i}_{q}": (k[d2 <= q * q] == i).sum() for i in range(3)}
        assert r.asDict() == want


def test_range_stats_match_brute_force(spark):
    """Points at one place, lines of several legs and without points, nulls: every line's whole multiset, no row for a pair."""
    from kerbline.operators import rangestats

    rng = random.Random(4)
    lines = [(i, [(float(rng.randint(0, 200)), float(rng.randint(0, 200))) for _ in range(2 + (i % 9 == 0))]) for i in range(50)] + [(50, [(5.0, 5.0), (5.0, 5.0)]), (51, [(9000.0, 9000.0), (9001.0, 9000.0)])]
    points = [(float(rng.randint(0, 60) * 3), float(rng.randint(0, 60) * 3), float(rng.randint(1, 40)), None if i % 11 == 0 else float(rng.randint(1, 9))) for i in range(600)]
    d = spark.createDataFrame(lines, "id long, coords array<struct<x:double,y:double>>")
    p = spark.createDataFrame(points, "px double, py double, a double, h double")
    from kerbline.operators.rangesums import all_legs, distance2

    out = rangestats.range_stats(d.select("id", all_legs(F.col("coords")).alias("legs")), p, [8, 45], ["a"], ["h"], {"h": 0.9, "a": 0.5}, ["a"])
    assert "d2" not in out._jdf.queryExecution().toString()
    got = {r["id"]: r.asDict() for r in out.collect()}
    assert sorted(got) == list(range(52))
    x, y = (np.array([q[c] for q in points]) for c in (0, 1))
    for i, line in lines:
        d2 = np.min([distance2(x, y, np.array([*a, *b])) for a, b in zip(line, line[1:])], axis=0)
        for r in (8, 45):
            a = np.sort([q[2] for q, e in zip(points, d2) if e <= r * r])
            h = [q[3] for q, e in zip(points, d2) if e <= r * r and q[3] is not None]
            n = len(a)
            gini = 2 * (a * np.arange(1, n + 1)).sum() / (n * a.sum()) - (n + 1) / n if n > 1 else 0
            want = [n, a.sum(), *((np.mean(h), np.std(h), np.quantile(h, 0.9)) if h else (0, 0, 0)), np.median(a) if n else 0, gini]
            assert [got[i][f"{c}_{r}"] for c in ("n", "a_sum", "h_mean", "h_std", "h_q", "a_q", "a_gini")] == pytest.approx(want, abs=1e-9)


def test_nearest_by_tile(spark):
    """Crowded and far points, several at one place, ids beyond a double's digits; polygons with holes. Every point comes once, without pairs."""
    rng = random.Random(8)
    big = 2**61
    right = [(big + i, rng.randint(0, 90), rng.randint(0, 90)) for i in range(400)] + [(big + 500, 5000, 5000), (-7, 45, 45), (-8, 45, 45)]
    left = [(i, rng.randint(0, 180) / 2, rng.randint(0, 180) / 2) for i in range(300)] + [(big, 45.0, 45.0), (400, 3000.0, 20.0)]
    near = gridjoin.nearest_join(spark.createDataFrame(left, "id long, px double, py double"), spark.createDataFrame(right, "rid long, rx long, ry long"), "id", 10.0)
    want = {p[0]: min(((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, q[0]) for q in right) for p in left}
    rows = near.collect()
    assert len(rows) == len(left) and {r.id: (round(r.d**2, 6), r.rid) for r in rows} == want
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()

    box = lambda x, y, s: [(float(a), float(b)) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]
    shapes = [(i, [box(rng.randint(0, 80), rng.randint(0, 80), 4)]) for i in range(30)] + [(99, [box(100, 100, 60), box(110, 110, 40)])]
    shapes = spark.createDataFrame(shapes, "rid long, rings array<array<struct<x:double,y:double>>>")
    spots = spark.createDataFrame([(i, k, *p) for i, (_, *p) in enumerate(left) for k in (0, 1)] + [(1000, 0, 130.0, 130.0), (1001, 0, 105.0, 130.0)], "id long, k int, px double, py double")
    got = {(r.id, r.k): r.d for r in gridjoin.nearest_polygon(spots, shapes, "id", 10.0, tag="k").collect()}
    from kerbline.functions.geometry import polygon_distance

    pairs = spots.crossJoin(shapes).groupBy("id", "k").agg(F.min(polygon_distance(F.col("px"), F.col("py"), F.col("rings"))).alias("d")).collect()
    assert got == {(r.id, r.k): pytest.approx(r.d, abs=1e-9) for r in pairs}
    assert got[1000, 0] == 20 and got[1001, 0] == 0


def test_lines_with_the_same_places_share_their_figures():
    held = np.array([[1, 0, 1], [0, 0, 0], [1, 0, 1], [0, 1, 1]] * 3, bool)
    sets, which = rangestats._sets(held)
    assert len(sets) == 3 and (sets[which] == held).all()
    sets, which = rangestats._sets(np.zeros((2, 0), bool))
    assert sets.shape == (1, 0) and list(which) == [0, 0]


def test_means_of_whole_numbers_are_sums_over_counts(spark):
    rng = np.random.default_rng(1)
    heights = [rng.integers(1, 51, n).astype(float).tolist() for n in rng.integers(50, 200, 30)]
    points = spark.createDataFrame([(3.0 * i, 0.0, h) for i, some in enumerate(heights) for h in some], "px double, py double, h double")
    lines = spark.createDataFrame([(i, 3.0 * i, 0.0, 3.0 * i + 0.5, 0.0) for i in range(30)], "id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: r.h_mean_2 for r in rangestats.range_stats(lines.select("id", one_leg().alias("legs")), points, [2], spread=["h"]).collect()}
    assert got == {i: sum(some) / len(some) for i, some in enumerate(heights)}


def test_entropy_sums_its_bins_once(spark):
    d = spark.range(3).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b"), (F.col("id") * 2.0).alias("c"))
    d = d.select("a", s.entropy([F.col(c) for c in "abc"]).alias("e"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2  # one total, one sum of parts
    want = {a: -sum(v / sum(c) * math.log(v / sum(c)) for v in c if v) for a in (0.0, 1.0, 2.0) for c in [(a, 3.0, 2 * a)]}
    assert {r.a: r.e for r in d.collect()} == pytest.approx(want)


def test_strips_share_numbers_among_counts_and_keep_the_order_of_lines():
    rng = np.random.default_rng(4)
    xy, codes = rng.integers(0, 200, (3000, 2)).astype(float), rng.integers(0, 7, (3000, 1))
    ends = rng.integers(60, 140, (200, 2))
    leg = np.concatenate((ends, ends + rng.integers(-9, 10, (200, 2))), axis=1).astype(float)
    for weight, packed in ((np.ones(3000), 4), (np.full(3000, 40.0), 3), (np.full(3000, 1000.0), 2), (np.full(3000, 2.0**40), 1)):
        strips = rangesums.Strips((0, 0, 201, 201), xy, weight, np.zeros((3000, 0)), codes, [7])
        assert strips.packed == packed
        near = rangesums.distance2(xy[:, 0], xy[:, 1], leg[:, None]) <= 50 * 50
        want = np.stack([near[:, codes[:, 0] == c] @ weight[codes[:, 0] == c] for c in range(7)], axis=1)
        assert (strips.sums(leg, [50.0])[:, 0] == want).all()


def test_strips_measure_as_all_distances_are_measured():
    rng = np.random.default_rng(6)
    xy = rng.integers(0, 90, (500, 2)) / 2
    leg = np.concatenate((rng.integers(0, 40, (60, 4)).astype(float), np.full((1, 4), 7.0)))
    strips = rangesums.Strips((0, 0, 46, 46), xy, np.ones(500), xy[:, :1], np.zeros((500, 0), np.int64), [])
    row, point = np.repeat(np.arange(61), 500), np.tile(np.arange(500), 61)
    assert (strips._distance2(point, leg, row) == rangesums.distance2(strips.x[point], strips.y[point], leg[row])).all()


def test_paths_read_plain_numbers():
    ids, starts, dst, w = np.arange(4), np.array([0, 2, 4, 6, 8]), np.array([1, 3, 0, 2, 1, 3, 0, 2]), np.array([1.0, 2.0, 1.0, 1.0, 1.0, 0.5, 2.0, 0.5])
    held = graph._held((ids, starts, dst, w))
    assert all(type(v) in (int, float) for part in held for v in part)
    dist, paths, order, before = graph._paths(held, 0)
    assert (dist, paths, order) == ([0, 1, 2, 2], [1, 1, 1, 1], [0, 1, 3, 2]) and [list(b) for b in before] == [[], [0], [1], [0]]
    assert list(graph._credit(held, 0)) == [0, 1, 0, 0]
