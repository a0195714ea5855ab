"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own, fitted on a bounded sample; a pair of centroids is a
cell. A query walks the cells in order of the summed distances of its halves to the two centroids, by a heap, until the
cells hold ``reach`` vectors; those are reranked by exact distance. Every vector is in the index. ``reach`` is the share
of the vectors that gives a recall of ``RECALL`` on the sample: small where vectors cluster, large where they do not.
Equal vectors are one entry, with as many of its smallest ids as a result can show. Entries are dealt over buckets of
about ``BLOCK`` (a crowded cell is split), queries stream past the entries of a bucket, and no candidate pair becomes a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.runtime import materialize

#: Vectors that the codebooks are fitted on.
SAMPLE = 20_000
#: Entries of a bucket, and queries that are compared with them at once.
BLOCK, QUERY_BLOCK = 4096, 256
#: Recall that ``reach`` is chosen for, on this many queries of the sample.
RECALL, TRIALS = 0.96, 200
#: Deals cells over buckets; tasks that buckets are dealt over at most.
SPREAD, MOST_TASKS = 2_654_435_761, 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Centroids; an empty one moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy() if k else x
    for _ in range(rounds if k else 0):
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        far = d[np.arange(len(x)), own].argsort()[::-1]
        for at, empty in enumerate(np.flatnonzero(n == 0)):
            c[empty] = x[far[at]]
    return c


def nearest_cells(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, reach: int) -> list[int]:
    """Cells ``i * len(d2) + j`` in order of ``d1[i] + d2[j]`` until they hold ``reach`` vectors; empty cells are left out."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    heap, seen, out, got = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < reach:
        _, a, b = heapq.heappop(heap)
        cell = int(o1[a]) * len(d2) + int(o2[b])
        if held[cell]:
            out.append(cell)
            got += int(held[cell])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(o1) and y < len(o2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))
    return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def choose_reach(sample: np.ndarray, half: int, books: tuple[np.ndarray, np.ndarray], total: int, k: int) -> int:
    """Vectors to rerank for each query: the least share of the sample, in eighths of powers of two, that finds ``RECALL``."""
    one, two = books
    d1, d2 = _distances(sample[:, :half], one), _distances(sample[:, half:], two)
    cell = d1.argmin(1) * len(two) + d2.argmin(1)
    held = np.bincount(cell, minlength=len(one) * len(two))
    needed = []
    for q in range(0, len(sample), max(1, len(sample) // TRIALS)):
        d = _distances(sample[q : q + 1], sample)[0]
        d[q] = np.inf
        true = cell[np.argpartition(d, min(k, len(d) - 1))[:k]]
        order = nearest_cells(d1[q], d2[q], held, len(sample))
        before = dict(zip(order, np.cumsum([0, *held[order][:-1]])))
        needed += [before[c] for c in true]
    needed = np.sort(needed)
    share = (needed[min(len(needed) - 1, int(RECALL * len(needed)))] + 1) / len(sample)
    return max(4 * k, int(np.ceil(share * 1.02 * total)))


def usable(vectors: DataFrame, id_col: str, vec_col: str, length: int | None = None) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part: no null, zero or non-finite vector, and of one length.

    Without a length, the one that most vectors have.
    """
    v = F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    if length is None:
        common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        length = common[0]["d"] if common else 0
    return rows.where(F.size("v") == length)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", reach: int | None = None
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every query row, its own row excluded, ties to smaller ids.

    ``queries`` has the columns of ``vectors``. Vectors that are null, zero, not finite or of another length than most (there is no
    distance between lengths) take no part, nor do null ids. Rows with a query's id are its own. Fewer candidates than k are all returned.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col), "vectors")
    order = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.dropDuplicates().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    entries = materialize(entries.select("vec_id", "v"), "entries")
    found = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    sample = np.array(found, float) if found else np.zeros((0, 2))
    half = max(1, sample.shape[1] // 2)
    asked = usable(queries, id_col, vec_col, sample.shape[1]).dropDuplicates()
    total = entries.count()
    # Cells hold a few tens of vectors on average, up to a fixed size of the codebooks.
    size = int(np.clip(round((total / 48) ** 0.5), 1, 256)) if total else 1
    books = (kmeans(sample[:, :half], size), kmeans(sample[:, half:], size) if sample.shape[1] > 1 else np.zeros((1, 0)))
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(books)

    def to_array(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for b in batches:
            if len(b):
                x = to_array(b.column(1))
                cell = _distances(x[:, :half], one).argmin(1) * len(two) + _distances(x[:, half:], two).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], ["vec_id", "v", "cell"])

    placed = materialize(entries.mapInArrow(place, "vec_id long, v array<double>, cell int"), "cells")
    held = np.zeros(len(books[0]) * len(books[1]), np.int64)  # at most 256 * 256 numbers
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        held[r["cell"]] = r["n"]
    reach = reach or choose_reach(sample, half, books, total, k)
    buckets = max(1, -(-total // BLOCK))
    counts = spark.sparkContext.broadcast(held)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), full = shared.value, counts.value
        for b in batches:
            if not len(b):
                continue
            x, rows = to_array(b.column(1)), []
            d1, d2 = _distances(x[:, :half], one), _distances(x[:, half:], two)
            for i in range(len(b)):
                by: dict[int, list[int]] = {}
                for cell in nearest_cells(d1[i], d2[i], full, reach):
                    for block in range(-(-int(full[cell]) // BLOCK)):
                        by.setdefault((cell * SPREAD + block) % buckets, []).append(cell << 32 | block)
                rows += [(i, bucket, units) for bucket, units in by.items()]
            at, bucket, units = zip(*rows) if rows else ((), (), ())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(units, pa.list_(pa.int64()))], ["bucket", "id", "v", "units"]
            )

    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK))
    sizes = spark.createDataFrame([(int(c), int(held[c])) for c in np.flatnonzero(held)], "cell int, n long")
    listed = placed.join(F.broadcast(sizes), "cell").withColumn("block", block)
    listed = listed.select(
        F.lit(0).alias("tag"),
        F.pmod(F.col("cell").cast("long") * SPREAD + F.col("block"), F.lit(buckets)).alias("bucket"),
        F.col("vec_id").alias("id"),
        "v",
        F.array(F.shiftleft(F.col("cell").cast("long"), 32).bitwiseOR(F.col("block"))).alias("units"),
    )
    probes = asked.mapInArrow(walk, "bucket long, id long, v array<double>, units array<long>").withColumn("tag", F.lit(1))
    both = listed.unionByName(probes).select("bucket", "tag", "id", "v", "units")
    both = both.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket", "tag")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        x = ids = units = None
        for b in batches:
            bucket, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(tag) != 0)) + 1
            for a, z in zip([0, *edges], [*edges, len(b)]):
                if a == z:
                    continue
                piece = b.slice(a, z - a)
                if bucket[a] != now:
                    now, parts, x = bucket[a], [], None
                if tag[a] == 0:
                    parts.append((to_array(piece.column(3)), piece.column(2).to_numpy(), piece.column(4).flatten().to_numpy()))
                    continue
                if not parts:
                    continue
                if x is None:
                    x, ids, units = (np.concatenate(p) for p in zip(*parts))
                    order = units.argsort(kind="stable")
                    x, ids, units = x[order], ids[order], units[order]
                for at in range(0, len(piece), QUERY_BLOCK):
                    some = piece.slice(at, QUERY_BLOCK)
                    yield _best(x, ids, units, to_array(some.column(3)), some.column(2).to_numpy(), some.column(4), k)

    near = both.mapInArrow(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(x: np.ndarray, ids: np.ndarray, units: np.ndarray, q: np.ndarray, query: np.ndarray, wanted: pa.Array, k: int) -> pa.RecordBatch:
    """The k nearest of each query among the entries (sorted by unit) of the units that it wants."""
    lengths = pa.compute.list_value_length(wanted).to_numpy()
    unit, who = wanted.flatten().to_numpy(), np.repeat(np.arange(len(q)), lengths)
    order = unit.argsort(kind="stable")
    unit, who = unit[order], who[order]
    d = np.full((len(q), len(x)), np.inf)
    starts = np.flatnonzero(np.r_[True, np.diff(unit) != 0])
    for a, z in zip(starts, [*starts[1:], len(unit)]):
        lo, hi = np.searchsorted(units, unit[a], "left"), np.searchsorted(units, unit[a], "right")
        if hi > lo:
            d[who[a:z], lo:hi] = _distances(q[who[a:z]], x[lo:hi])
    d[query[:, None] == ids[None]] = np.inf
    spare = min(len(x), k + 16)  # the fast distances are rounded; the nearest by these are measured again
    first = np.argpartition(d, spare - 1, axis=1)[:, :spare]
    rows = np.repeat(np.arange(len(q)), spare)
    cols = first.ravel()
    fine = np.isfinite(d[rows, cols])
    rows, cols = rows[fine], cols[fine]
    exact = np.sqrt(((q[rows] - x[cols]) ** 2).sum(1))
    order = np.lexsort((ids[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    top = nth < k
    return pa.RecordBatch.from_arrays([pa.array(query[rows[top]]), pa.array(ids[cols[top]]), pa.array(exact[top])], ["query_id", "vec_id", "score"])


def brute_force(x: np.ndarray, ids: np.ndarray, k: int, queries: np.ndarray) -> dict[int, list[int]]:
    """The exact k nearest, for measuring recall."""
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        out[int(q)] = [int(i) for i in ids[np.lexsort((ids, d))[:k]] if i != q]
    return out
