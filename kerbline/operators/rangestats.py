"""Order statistics over the points within a distance of lines: the whole multiset of each line counts, but no pair is a row.

Lines and points meet by tile. A block of lines that lie close together shares the points that any of them can reach, sorted once by
each value; which of them a line holds is a row of numbers, from whose cumulative sums ranks, quantiles and Gini coefficients follow.
Distances are taken to places, however many points are at one, and lines that hold the same places share their figures.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.rangesums import distance2
from kerbline.operators.tiles import blocks, by_tile

#: Numbers of a block that are held at once; lines that share the sorting of a block, more of them if so many points are at one place.
HELD, LINES, CROWD = 1 << 18, 256, 16


def _ranked(held: np.ndarray, v: np.ndarray, places: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The values at given places (from 0) of each line's points, which stand in the order of ``v``; places beyond are of no meaning."""
    total = np.cumsum(held, axis=1, dtype=np.int32)
    base = np.arange(len(held), dtype=np.int64) * (len(held) and int(total[:, -1].max(initial=0)) + 2)
    flat = (total + base[:, None]).ravel()
    return [v[np.minimum(np.searchsorted(flat, base + p, side="right") - np.arange(len(held)) * held.shape[1], len(v) - 1)] for p in places]


def _quantile(held: np.ndarray, v: np.ndarray, q: float) -> np.ndarray:
    """Interpolated, as PERCENTILE does; 0 without values."""
    if not len(v):
        return np.zeros(len(held))
    n = held.sum(axis=1, dtype=np.int64)
    at = q * (np.maximum(n, 1) - 1)
    low, high = _ranked(held, v, [np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)])
    part = at - np.floor(at)
    return np.where(n == 0, 0.0, np.where(low == high, low, (np.ceil(at) - at) * low + part * high))


def _gini(held: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of the finite and positive values, as ``scalar.gini``."""
    good = (v > 0) & np.isfinite(v)
    held, v = held[:, good], v[good]
    n = held.sum(axis=1, dtype=np.int64)
    total = held @ v
    ranked = (held * np.cumsum(held, axis=1, dtype=np.float64)) @ v
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((n >= 2) & (total > 0), 2 * ranked / (n * total) - (n + 1) / n, 0.0)


def _sets(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and which of them each row is."""
    if not held.shape[1]:
        return held[:1], np.zeros(len(held), np.int64)
    bits = np.packbits(held, axis=1)
    _, first, which = np.unique(bits.view(np.dtype((np.void, bits.shape[1])))[:, 0], return_index=True, return_inverse=True)
    return held[first], which


def range_stats(
    lines: DataFrame, points: DataFrame, radii: Sequence[float], sums: Sequence[str] = (), spread: Sequence[str] = (), quantiles: dict[str, float] | None = None, gini: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(id, keep.., n_<r>, <c>_sum_<r>, <c>_mean_<r>, <c>_std_<r>, <c>_q_<r>, <c>_gini_<r>)`` for every line of ``lines(id, legs, ..)``.

    Over the points ``(px, py, ..)`` within r: their number, sums of the columns ``sums``, means and population deviations of ``spread``,
    the quantile given for each column of ``quantiles``, Gini coefficients of ``gini``. A null or NaN is left out of its column's
    figures. All are 0 without values.
    """
    quantiles = quantiles or {}
    columns = list(dict.fromkeys([*sums, *spread, *quantiles, *gini]))
    names = [f"{n}_{r:g}" for r in radii for n in ("n", *[f"{c}_sum" for c in sums], *[f"{c}_{k}" for c in spread for k in ("mean", "std")], *[f"{c}_q" for c in quantiles], *[f"{c}_gini" for c in gini])]
    flat = F.flatten(F.transform("legs", lambda p: F.array(*[p[c].cast("double") for c in ("x0", "y0", "x1", "y1")])))
    left = lines.select("id", "legs", F.concat(F.array(*[F.col(c).cast("double") for c in keep]), flat).alias("v") if keep else flat.alias("v"))
    right = points.select(*[F.col(c).cast("double").alias(c) for c in ("px", "py")], F.array(*[F.col(c).cast("double") for c in ("px", "py", *columns)]).alias("v"))
    right = right.select("px", "py", "v").where("px is not null and py is not null")
    widest, k = float(max(radii)), len(keep)

    def near(ids: np.ndarray, count: np.ndarray, v: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        mine = np.arange(len(v)) - np.repeat(np.cumsum(count) - count, count) < k
        handed, leg, count = v[mine].reshape(len(ids), k), v[~mine].reshape(-1, 4), (count - k) // 4
        first = np.cumsum(count) - count
        box = [f.reduceat(f(leg[:, c], leg[:, c + 2]), first) for f in (np.minimum, np.maximum) for c in (0, 1)]
        for tile in blocks((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, widest):
            area = (np.ptp(box[0][tile]) + 1) * (np.ptp(box[1][tile]) + 1)
            near_tile = p[_where(p, box, tile, widest)]
            crowd = len(near_tile) / max(1, len(np.unique(near_tile[:, 0] + 1j * near_tile[:, 1]))) / CROWD
            side = min(2 * widest, max(widest / 8, (LINES * np.clip(crowd, 1, 4) * area / len(tile)) ** 0.5))  # enough lines to share the sorting
            for some in blocks((box[0] + box[2])[tile] / 2, (box[1] + box[3])[tile] / 2, side):
                some = tile[some]
                q = near_tile[_where(near_tile, box, some, widest)]
                got = _block(leg, first[some], count[some], q)
                data = np.ascontiguousarray(np.concatenate((handed[some], got), axis=1))
                lists = pa.ListArray.from_arrays(np.arange(0, data.size + 1, data.shape[1], dtype=np.int32), pa.array(data.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), lists], ["id", "s"])

    def _where(p: np.ndarray, box: list[np.ndarray], some: np.ndarray, r: float) -> np.ndarray:
        r = r * (1 + 1e-9) + 1e-9
        return (p[:, 0] >= box[0][some].min() - r) & (p[:, 0] <= box[2][some].max() + r) & (p[:, 1] >= box[1][some].min() - r) & (p[:, 1] <= box[3][some].max() + r)

    def _block(leg: np.ndarray, first: np.ndarray, count: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first), len(names)))
        if not len(q):
            return out
        xy, place = np.unique(q[:, 0] + 1j * q[:, 1], return_inverse=True)
        xy = np.stack([xy.real, xy.imag], axis=1)
        value = {c: q[:, 2 + i] for i, c in enumerate(columns)}
        order = {c: (o := value[c].argsort(kind="stable"))[~np.isnan(value[c][o])] for c in (*quantiles, *gini)}
        total = np.stack([np.bincount(place, w, len(xy)) for w in (np.ones(len(q)), *[np.nan_to_num(value[c], posinf=np.inf, neginf=-np.inf) for c in sums])], axis=1)
        moments = {}
        for c in spread:
            known = ~np.isnan(value[c])
            middle = value[c][known].mean() if known.any() else 0.0  # deviations are taken from it, means are not
            x = np.where(known, value[c] - middle, 0.0)
            moments[c] = np.stack([np.bincount(place, w, len(xy)) for w in (known, x, x * x, np.where(known, value[c], 0.0))], axis=1)

        def _figures(held: np.ndarray) -> np.ndarray:
            """The figures of one radius for sets of places."""
            near_ = held.astype(float)
            out_ = [near_ @ total]
            for c in spread:
                n_, s1, s2, s = (near_ @ moments[c]).T
                n_ = np.maximum(n_, 1)
                out_ += [(s / n_)[:, None], np.sqrt(np.maximum(s2 / n_ - (s1 / n_) ** 2, 0))[:, None]]
            any_ = held.any(axis=0)[place]
            for c, f in (*[(c, lambda h, v, c=c: _quantile(h, v, quantiles[c])) for c in quantiles], *[(c, _gini) for c in gini]):
                o = order[c][any_[order[c]]]
                out_.append(f(held[:, place[o]], value[c][o])[:, None])
            return np.concatenate(out_, axis=1)

        chunk, few = max(1, HELD // len(xy)), max(1, HELD // len(q))
        for at in range(0, len(first), chunk):
            n = count[at : at + chunk]
            begin = np.cumsum(n) - n
            mine = leg[np.repeat(first[at : at + chunk] - begin, n) + np.arange(n.sum())]
            d2 = distance2(xy[:, 0], xy[:, 1], mine[:, None])
            d2 = d2 if len(d2) == len(n) else np.minimum.reduceat(d2, begin)
            width = len(names) // len(radii)
            for i, r in enumerate(radii):
                sets, which = _sets(d2 <= r * r)
                got = np.concatenate([_figures(sets[a : a + few]) for a in range(0, len(sets), few)])
                out[at : at + chunk, i * width : (i + 1) * width] = got[which]
        return out

    found, _ = by_tile(left, right, widest, near, "id long, s array<double>")
    return found.select("id", *[F.get("s", i).alias(n) for i, n in enumerate([*keep, *names])])
