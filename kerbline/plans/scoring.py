"""Model input, graph network scores, uncertainty and uniform ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators import gnn
from kerbline.operators.hoods import segment_returns
from kerbline.plans.graphs import _GRAPH as GRAPH
from kerbline.plans.registry import query
from kerbline.plans.tables import Tables
from kerbline.runtime import materialize

R6 = lambda c, n: F.round(c, 6).alias(n)
LAYERS, HIDDEN = 2, 8


@query("win12_grf13_uniform_ranks", "SELECT rid, round((rank() OVER (ORDER BY area) - 1 + (count(*) OVER (PARTITION BY area) - 1) / 2.0) / ((SELECT count(*) FROM buildings) - 1), 6) AS q FROM buildings")
def uniform_ranks(t: Tables) -> DataFrame:
    return gnn.uniform_ranks(t.buildings.select("rid", "area"), "area", "q").select("rid", R6(F.col("q"), "q"))


@query(
    "mth16_17_scale",
    """SELECT rid, round(CASE WHEN area <= 900 THEN 0.0 WHEN area >= 2000 THEN 1.0 WHEN area < 1200 THEN (area - 900) / 300 / 2 ELSE (1 + (area - 1200) / 800) / 2 END, 6) AS area,
       round(1 / (1 + exp(-(height - 25) / 10.0)), 6) AS s, greatest(height - 25, 0) AS relu FROM buildings""",
)
def scale(t: Tables) -> DataFrame:
    from kerbline.functions.scalar import sigmoid

    d = gnn.quantile_scale(t.buildings.select("rid", "area", "height"), {"area": [900.0, 1200.0, 2000.0]})
    return d.select("rid", R6(F.col("area"), "area"), R6(sigmoid((F.col("height") - 25) / 10.0), "s"), F.greatest(F.col("height") - 25, F.lit(0)).alias("relu"))


def _inputs(t: Tables, cap: int | None = 20) -> tuple[DataFrame, DataFrame]:
    """A small model input: four scaled columns and two return probabilities, of every segment; the segments' ends."""
    ends = t.segments.select("id", "a", "b")
    walk = segment_returns(ends, 2, cap)
    base = t.segments.select("id", *[(F.col(c) / 10007.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    x = base.join(walk, "id", "left").select("id", F.array("x0", "y0", "x1", "y1", F.coalesce("p1", F.lit(0.0)), F.coalesce("p2", F.lit(0.0))).alias("x"))
    return x, ends


def _number(v: float) -> str:
    return f"({float(v):.17e})"


def _linear_sql(w: gnn.Weights, name: str, columns: list[str]) -> list[str]:
    bias = w.get(f"{name}.bias", [0.0] * len(w[f"{name}.weight"]))
    return [" + ".join([_number(b), *[f"{_number(v)} * {c}" for v, c in zip(row, columns)]]) for row, b in zip(w[f"{name}.weight"], bias)]


def _encode_sql(w: gnn.Weights, linear: str, norm: str, columns: list[str]) -> str:
    """A linear map, normalisation with the statistics of training, and ReLU, as h0, h1, .."""
    out = []
    for j, e in enumerate(_linear_sql(w, linear, columns)):
        scale, shift, mean, var = (_number(w[f"{norm}.{k}"][j]) for k in ("weight", "bias", "running_mean", "running_var"))
        out.append(f"greatest(({e} - {mean}) / sqrt({var} + 1e-5) * {scale} + {shift}, 0.0) AS h{j}")
    return ", ".join(out)


def network_sql(w: gnn.Weights, layers: int, x: str, graph_sql: str) -> str:
    """``(id, score)`` for inputs ``x(id, x0, x1, ..)``: the network spelled out from its definition."""
    inputs, wide = w["encoder.net.0.weight"].shape[1], w["encoder.net.0.weight"].shape[0]
    size, parts = w["encoder.net.4.weight"].shape[0], []
    h = [f"h{j}" for j in range(size)]
    parts.append(f"e0 AS (SELECT id, {_encode_sql(w, 'encoder.net.0', 'encoder.net.1', [f'x{j}' for j in range(inputs)])} FROM ({x}))")
    parts.append(f"l0 AS (SELECT id, {_encode_sql(w, 'encoder.net.4', 'encoder.net.5', [f'h{j}' for j in range(wide)])} FROM e0)")
    for i in range(layers):
        n = f"layers.{i}"
        gate = ", ".join(f"greatest({e}, 0.0) AS g{j}" for j, e in enumerate(_linear_sql(w, f"{n}.gate.0", [f"a.{c}" for c in h] + [f"b.{c}" for c in h])))
        sent = ", ".join(f"{e} AS m{j}" for j, e in enumerate(_linear_sql(w, f"{n}.W", [f"b.{c}" for c in h])))
        parts.append(f"t{i} AS (SELECT g.src AS id, {gate}, {sent} FROM ({graph_sql}) g JOIN l{i} a ON a.id = g.src JOIN l{i} b ON b.id = g.dst)")
        strength = _linear_sql(w, f"{n}.gate.2", [f"g{j}" for j in range(size)])[0]
        mean = ", ".join(f"avg(s * m{j}) AS m{j}" for j in range(size))
        parts.append(f"s{i} AS (SELECT id, {mean} FROM (SELECT *, 1 / (1 + exp(-({strength}))) AS s FROM t{i}) GROUP BY id)")
        both = ", ".join(f"h{j} + coalesce(m{j}, 0.0) AS z{j}" for j in range(size))
        mu = f"({' + '.join(f'z{j}' for j in range(size))}) / {size}"
        var = f"({' + '.join(f'(z{j} - mu) * (z{j} - mu)' for j in range(size))}) / {size}"
        new = ", ".join(f"greatest((z{j} - mu) / sqrt(var + 1e-5) * {_number(w[f'{n}.norm.weight'][j])} + {_number(w[f'{n}.norm.bias'][j])}, 0.0) AS h{j}" for j in range(size))
        parts.append(f"z{i} AS (SELECT *, {var} AS var FROM (SELECT *, {mu} AS mu FROM (SELECT id, {both} FROM l{i} LEFT JOIN s{i} USING (id))))")
        parts.append(f"l{i + 1} AS (SELECT id, {new} FROM z{i})")
    head = ", ".join(f"greatest({e}, 0.0) AS y{j}" for j, e in enumerate(_linear_sql(w, "head.0", h)))
    last = _linear_sql(w, "head.3", [f"y{j}" for j in range(size // 2)])[0]
    return f"WITH {', '.join(parts)} SELECT id, {last} AS score FROM (SELECT id, {head} FROM l{layers})"


WEIGHTS = gnn.random_weights(6, HIDDEN, LAYERS, wide=12)
_WALK = f"SELECT src, dst, count(*) / CAST(sum(count(*)) OVER (PARTITION BY src) AS DOUBLE) AS w FROM ({GRAPH}) GROUP BY src, dst"
_X = f"""SELECT id, x0 / 10007.0 AS x0, y0 / 10007.0 AS x1, s.x1 / 10007.0 AS x2, y1 / 10007.0 AS x3, 0.0::DOUBLE AS x4, coalesce(p2, 0.0) AS x5 FROM segments s LEFT JOIN
    (SELECT a.src AS id, sum(a.w * b.w) AS p2 FROM ({_WALK}) a JOIN ({_WALK}) b ON a.dst = b.src AND b.dst = a.src GROUP BY a.src) USING (id)"""
_SCORES = network_sql(WEIGHTS, LAYERS, _X, GRAPH)


@query(
    "grf9_11_predict",
    f"""SELECT id, round(score, 6) AS score, round((rank() OVER (ORDER BY s) - 1 + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / (count(*) OVER () - 1), 6) AS pred_density
        FROM (SELECT id, score, round(score, 8) AS s FROM ({_SCORES}))""",
)
def predict(t: Tables) -> DataFrame:
    """Weights are random, as no checkpoint is public. Ranks are of rounded scores, which any order of sums gives alike."""
    x, ends = _inputs(t)
    scores = gnn.predict(x, ends, WEIGHTS, LAYERS).select("id", R6(F.col("score"), "score"), F.round("score", 8).alias("s"))
    return gnn.uniform_ranks(materialize(scores, "scores"), "s", "pred_density").select("id", "score", R6(F.col("pred_density"), "pred_density"))


@query("grf12_agg24_uncertainty")
def uncertain(t: Tables) -> DataFrame:
    """Over all segments of every node, where ``grf9_11_predict`` and its SQL keep 20."""
    x, ends = _inputs(t, cap=None)
    scores = gnn.predict(x, ends, WEIGHTS, LAYERS, runs=30, cap=None)
    return gnn.uncertainty(scores).select("id", R6(F.col("score"), "score"), R6(F.col("std"), "pred_uncertainty"))
