"""A gated graph network's forward pass, dropout runs and the transforms around it, with weights handed in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.hoods import by_block
from kerbline.runtime import materialize

Weights = dict[str, np.ndarray]
EPS = 1e-5
#: Numbers of gates that are held at once, which a core's cache takes, and how many times as many a single node may take; rows of a batch.
NUMBERS, HUB, ROWS = 1 << 16, 16, 10_000


def random_weights(inputs: int, hidden: int, layers: int, seed: int = 0, wide: int | None = None) -> Weights:
    """Weights of the model's shape under its own names, for tests and for runs without a checkpoint.

    A linear map ``x W' + b`` keeps W as ``(outputs, inputs)``; ``wide`` is the width of the encoder's first layer.
    """
    rng = np.random.default_rng(seed)
    wide = wide or hidden
    w: Weights = {}

    def linear(name: str, a: int, b: int, bias: bool = True) -> None:
        w[f"{name}.weight"] = rng.normal(0, 1 / np.sqrt(a), (b, a))
        if bias:
            w[f"{name}.bias"] = rng.normal(0, 0.1, b)

    def batch_norm(name: str, n: int) -> None:
        w.update({f"{name}.weight": rng.uniform(0.5, 1.5, n), f"{name}.bias": rng.normal(0, 0.1, n), f"{name}.running_mean": rng.normal(0, 0.1, n), f"{name}.running_var": rng.uniform(0.5, 1.5, n)})

    linear("encoder.net.0", inputs, wide)
    batch_norm("encoder.net.1", wide)
    linear("encoder.net.4", wide, hidden)
    batch_norm("encoder.net.5", hidden)
    for i in range(layers):
        linear(f"layers.{i}.W", hidden, hidden, bias=False)
        linear(f"layers.{i}.gate.0", 2 * hidden, hidden)
        linear(f"layers.{i}.gate.2", hidden, 1)
        w.update({f"layers.{i}.norm.weight": rng.uniform(0.5, 1.5, hidden), f"layers.{i}.norm.bias": rng.normal(0, 0.1, hidden)})
    linear("head.0", hidden, hidden // 2)
    linear("head.3", hidden // 2, 1)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    mean, var = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - mean) / np.sqrt(var + EPS) * scale + shift


def _linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w.get(f"{name}.bias", 0.0)


def _batch_norm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """With the statistics of training, as always in inference."""
    return (x - w[f"{name}.running_mean"]) / np.sqrt(w[f"{name}.running_var"] + EPS) * w[f"{name}.weight"] + w[f"{name}.bias"]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x.reshape(len(x), -1))
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if len(x) else np.zeros(1, np.int32), pa.array(x.ravel()))


def _kept(ids: np.ndarray, runs: int, width: int, layer: int, dropout: float) -> np.ndarray:
    """Dropout factors ``(rows, runs + 1, width)``; run 0 has none. They depend on row, run, layer and unit alone, so that a
    lost task gives the same again."""
    out = np.ones((len(ids), runs + 1, width))
    if dropout and runs:
        unit = np.arange(runs * width, dtype=np.uint64) + np.uint64(layer << 32)
        h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] + unit * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        u = (h ^ (h >> np.uint64(31))).astype(float) / 2.0**64
        out[:, 1:] = ((u >= dropout) / (1 - dropout)).reshape(len(ids), runs, width)
    return out


def _rows(df: DataFrame, w: Weights, f) -> DataFrame:
    """``(id, x)`` with ``f(x, ids, weights)`` in the place of every vector."""
    shared = df.sparkSession.sparkContext.broadcast(w)  # as large as the network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                y = f(_matrix(b.column(1)), b.column(0).to_numpy(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(y)], ["id", "x"])

    return df.select("id", "x").mapInArrow(run, "id long, x array<double>")


def predict(nodes: DataFrame, edges: DataFrame, w: Weights, layers: int, runs: int = 0, dropout: float = 0.2, cap: int | None = 20) -> DataFrame:
    """``(id, run, score)`` for ``nodes(id, x array<double>)``; run 0 is without dropout. All neighbours are used, so results do
    not depend on sampling.

    Of a segment graph, ``edges`` are the segments' ``ends(id, a, b)``: a block gets the inputs of all segments that it depends on
    and goes through all layers, so that no vector between them is written; a node keeps its first ``cap`` segments, or all without a cap.
    Of any other graph they are ``edges(src, dst)``:
    these are joined and shuffled once a layer, each with all runs of its far end, which takes much disk for many runs.
    """
    hidden = w["encoder.net.4.weight"].shape[0]

    def encode(x: np.ndarray, ids: np.ndarray, w: Weights) -> np.ndarray:
        h = np.maximum(_batch_norm(_linear(x, w, "encoder.net.0"), w, "encoder.net.1"), 0)
        h = h[:, None] * _kept(ids, runs, h.shape[1], 100, dropout)
        return np.maximum(_batch_norm(_linear(h, w, "encoder.net.4"), w, "encoder.net.5"), 0)

    def head(x: np.ndarray, ids: np.ndarray, w: Weights) -> np.ndarray:
        y = np.maximum(_linear(x.reshape(len(x), runs + 1, hidden), w, "head.0"), 0)
        return _linear(y * _kept(ids, runs, y.shape[2], 200, dropout), w, "head.3")

    if "src" not in edges.columns:
        scores = _through_blocks(nodes, edges, w, layers, runs, dropout, encode, head, cap)
        return scores.select("id", F.posexplode("x").alias("run", "score"))
    h = materialize(_rows(nodes.select(F.col("id").cast("long").alias("id"), "x"), w, encode), "encoded")
    for i in range(layers):
        h = materialize(_layer(h, edges, w, i, runs, dropout), f"layer{i}")
    return _rows(h, w, head).select("id", F.posexplode("x").alias("run", "score"))


def _layer(h: DataFrame, edges: DataFrame, w: Weights, i: int, runs: int, dropout: float) -> DataFrame:
    """One layer: each edge brings its far end's vectors to its near end, whose row comes first and takes their gated mean."""
    hidden, name = w[f"layers.{i}.W.weight"].shape[0], f"layers.{i}"
    shared = h.sparkSession.sparkContext.broadcast({k: v for k, v in w.items() if k.startswith(name + ".")})
    far = edges.select(F.col("src").cast("long").alias("at"), F.col("dst").cast("long").alias("id")).join(h, "id")
    both = h.select(F.col("id").alias("at"), F.lit(0).alias("sent"), "x").unionByName(far.select("at", F.lit(1).alias("sent"), "x"))
    both = both.repartition("at").sortWithinPartitions("at", "sent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        cut = p[f"{name}.gate.0.weight"][:, :hidden].T, p[f"{name}.gate.0.weight"][:, hidden:].T
        own: tuple | None = None  # the node whose messages go on in the next batch: id, vectors, sum, number

        def done(ids: np.ndarray, x: np.ndarray, total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            mean = total / np.maximum(n, 1)[:, None, None] * _kept(ids, runs, hidden, i, dropout)
            y = np.maximum(layer_norm(x + mean, p[f"{name}.norm.weight"], p[f"{name}.norm.bias"]), 0)
            return pa.RecordBatch.from_arrays([pa.array(ids), _lists(y)], ["id", "x"])

        for b in batches:
            if not len(b):
                continue
            at, sent = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = _matrix(b.column(2)).reshape(len(b), runs + 1, hidden)
            heads = np.flatnonzero(sent == 0)
            ids, nodes = at[heads], x[heads]
            total, n = np.zeros_like(nodes), np.zeros(len(heads))
            if own is not None:
                ids, nodes = np.r_[own[0], ids], np.concatenate((own[1], nodes))
                total, n = np.concatenate((own[2], total)), np.r_[own[3], n]
            edge = np.flatnonzero(sent == 1)
            to = np.searchsorted(ids, at[edge])
            here = to < len(ids)
            here[here] = ids[to[here]] == at[edge][here]  # an edge from no node is left out
            edge, to = edge[here], to[here]
            if len(edge):
                other = x[edge]
                gate = np.maximum((nodes @ cut[0])[to] + other @ cut[1] + p[f"{name}.gate.0.bias"], 0)
                message = sigmoid(_linear(gate, p, f"{name}.gate.2")) * _linear(other, p, f"{name}.W")
                first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                total[to[first]] += np.add.reduceat(message, first)
                n[to[first]] += np.diff(np.r_[first, len(to)])
            if len(ids):
                if len(ids) > 1:
                    yield done(ids[:-1], nodes[:-1], total[:-1], n[:-1])
                own = ids[-1:], nodes[-1:], total[-1:], n[-1:]
        if own is not None:
            yield done(*own)

    return both.mapInArrow(run, "id long, x array<double>")


def _groups(at: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of equal numbers ``at``, as matrices of groups of one size."""
    if not len(at):
        return
    order = at.argsort(kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    size = np.diff(np.r_[start, len(at)])
    for q in np.unique(size):
        yield order[start[size == q][:, None] + np.arange(q)]


def _gated_means(x: np.ndarray, ids: np.ndarray, ends: Sequence[np.ndarray], p: Weights, name: str) -> np.ndarray:
    """Means ``(rows, runs + 1, hidden)`` of the gated messages that segments get from all others of their nodes.

    ``ends`` are two nodes of each row, -1 for none. Nodes of as many segments go together, as many as fit into ``NUMBERS``; a
    node's messages are one product of matrices for each run.
    """
    n, runs, hidden = x.shape
    gate, strength = p[f"{name}.gate.0.weight"], p[f"{name}.gate.2.weight"][0]
    own, other, message = x @ gate[:, :hidden].T + p[f"{name}.gate.0.bias"], x @ gate[:, hidden:].T, x @ p[f"{name}.W.weight"].T
    row = [np.flatnonzero(e >= 0) for e in ends]
    seg, node = np.concatenate(row), np.concatenate([e[k] for e, k in zip(ends, row)])
    sent, many = np.zeros((len(seg), runs, hidden)), np.zeros(len(seg))
    of = lambda values, at: np.ascontiguousarray(values[at].transpose(0, 2, 1, 3))
    for group in _groups(node):
        q = group.shape[1]
        some = max(1, NUMBERS // (q * q * runs * hidden))
        rows = max(1, HUB * NUMBERS // (q * runs * hidden))  # of a node with very many segments, at once
        for k in range(0, len(group) if q > 1 else 0, some):
            place = group[k : k + some]
            at = seg[place]
            near, far, says = of(own, at), of(other, at), of(message, at)
            for r in range(0, q, rows):
                part = slice(r, r + rows)
                gates = near[:, :, part, None] + far[:, :, None]  # (nodes, runs, rows, q, hidden)
                np.maximum(gates, 0, out=gates)
                strong = (gates.reshape(-1, hidden) @ strength).reshape(gates.shape[:4])
                strong = sigmoid(strong + p[f"{name}.gate.2.bias"][0])
                apart = ids[at[:, part]][:, :, None] != ids[at][:, None]  # a segment sends itself nothing
                strong *= apart[:, None]
                sent[place[:, part]] = (strong @ says).transpose(0, 2, 1, 3)
                many[place[:, part]] = apart.sum(axis=2)
    total, count = np.zeros_like(x), np.zeros(n)
    for side in (slice(0, len(row[0])), slice(len(row[0]), None)):  # a segment is once in each
        total[seg[side]] += sent[side]
        count[seg[side]] += many[side]
    total /= np.maximum(count, 1)[:, None, None]
    return total


def _through_blocks(nodes: DataFrame, ends: DataFrame, w: Weights, layers: int, runs: int, dropout: float, encode, head, cap: int | None) -> DataFrame:
    """``(id, x)`` with the scores of all runs, through all layers block by block."""
    hidden = w["encoder.net.4.weight"].shape[0]
    shared = nodes.sparkSession.sparkContext.broadcast(w)  # as large as the network

    def local(ids: np.ndarray, u: np.ndarray, v: np.ndarray, _: np.ndarray, own: np.ndarray, rest: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        need = [own]  # of the last layer; those before it need all around
        for _ in range(layers):
            near = np.zeros(max(u.max(), v.max()) + 2, bool)  # the last is for no node
            near[u[need[-1]]] = near[v[need[-1]]] = True
            near[-1] = False
            need.append(need[-1] | near[u] | near[v])
        x, rows = _matrix(rest[0]), np.flatnonzero(need[-1])
        h = encode(x[rows], ids[rows], p)
        for i in range(layers):
            to = need[layers - 1 - i][rows]
            name = f"layers.{i}"
            mean = _gated_means(h, ids[rows], (u[rows], v[rows]), p, name)[to]
            rows, h = rows[to], h[to]
            mean *= _kept(ids[rows], runs, hidden, i, dropout)
            h += mean
            h = np.maximum(layer_norm(h, p[f"{name}.norm.weight"], p[f"{name}.norm.bias"]), 0)
        for k in range(0, len(rows), ROWS):
            some = slice(k, k + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[some]]), _lists(head(h[some], ids[rows[some]], p))], ["id", "x"])

    return by_block(ends, max(1, layers), local, "id long, x array<double>", nodes.select(F.col("id").cast("long").alias("id"), "x"), cap)


def uncertainty(scores: DataFrame) -> DataFrame:
    """``(id, score, std)``: run 0's score and the population deviation over the dropout runs."""
    std = F.stddev_pop(F.when(F.col("run") > 0, F.col("score")))
    return scores.groupBy("id").agg(F.max(F.when(F.col("run") == 0, F.col("score"))).alias("score"), F.coalesce(std, F.lit(0.0)).alias("std"))


def uniform_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Tie-averaged ranks scaled to 0..1. Ranks of distinct values are offsets from counts, so no task sorts all rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange(F.col(value)).withColumn("part", F.spark_partition_id())
    local = Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = materialize(parts.withColumn("before", F.coalesce(F.sum("n").over(local), F.lit(0))), "ranks")
    sizes = ranked.groupBy("part").agg(F.sum("n").alias("size"))
    base = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = sizes.select("part", base.alias("base"), F.sum("size").over(Window.partitionBy()).alias("total"))
    at = ranked.join(offset, "part")
    rank = F.when(F.col("total") > 1, (F.col("base") + F.col("before") + (F.col("n") - 1) / 2) / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return df.join(at.select(value, rank.alias(name)), value)


def quantile_scale(df: DataFrame, columns: dict[str, list[float]]) -> DataFrame:
    """Piecewise-linear transform of each column by its fitted quantiles, clipped to 0..1; null becomes NaN.

    A value that several quantiles share goes to the middle of their places: the mean of both directions of interpolation.
    The quantiles travel as arrays, so that hundreds of columns with a thousand of them need no generated code.
    """
    shared = df.sparkSession.sparkContext.broadcast({c: np.array(q, float) for c, q in columns.items()})  # as large as the scaler
    fields = [f"`{f.name}` {'double' if f.name in columns else f.dataType.simpleString()}" for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, column in zip(b.schema.names, b.columns):
                q = shared.value.get(name)
                if q is not None:
                    x, place = column.cast(pa.float64()).to_numpy(zero_copy_only=False), np.linspace(0, 1, len(q))
                    y = 0.5 * (np.interp(x, q, place) - np.interp(-x, -q[::-1], -place[::-1]))
                    column = pa.array(np.where(x <= q[0], 0.0, np.where(x >= q[-1], 1.0, y)))
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, b.schema.names)

    return df.mapInArrow(run, ", ".join(fields))
