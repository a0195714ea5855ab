"""SimHash near-duplicate classes by the generalised pigeonhole principle.

Fingerprints whose Hamming distance is at most ``radius`` are linked. The 64 bits are cut into parts of correlated bits
and part i gets a threshold t_i with sum(t_i + 1) = radius + 1: two fingerprints in reach of each other are within t_i
on some part i (a part with t_i = -1 is never probed). The split and the thresholds minimise the expected number of
probes and candidates, estimated on a bounded sample by dynamic programming; they change cost only, never the result.
A part's value that more than ``BUCKET`` fingerprints share is not expanded into pairs: its members and probes meet at
the values one bit away from them (at most 65 fingerprints are that near to one value), which finds the same links.

64 bits of three-word shingles see copies that differ in a word or two. :func:`similar` is for copies with a word in fifty
replaced (a Jaccard similarity of 0.8 over five-word shingles): 128 bits of distinct words, linked within ``LIMIT``, by the same
method. A fingerprint goes to the slot of its own key on each part and to those one flipped bit away where the part's
threshold says so; a slot compares its probes with its own rows, by the whole fingerprint. All pairs within ``LIMIT`` meet,
whatever the parts planned. Large groups of copies are connected through pivots, not through their pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import same_row, text_key
from kerbline.operators.components import connected_components
from kerbline.runtime import materialize

#: Fingerprints that the split of the bits is fitted on.
SAMPLE = 20_000
#: Fingerprints in one bucket that are compared pair by pair.
BUCKET = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Wide fingerprints: words of 64 bits, and the distance that still links.
WIDE, LIMIT = 2, 15
#: Weight of a probe, a row that is shuffled, in comparisons; low enough that the plan is the same from some ten thousand texts on.
PROBE = 8.0
#: Pairs of wide fingerprints that are compared at once, and those of a slot that is compared together with others.
PAIRS, BATCHED = 1 << 20, 1 << 12
#: Rows of a slot in one place; the places of a slot are connected in a second pass.
CROWD = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles of the whole text, as a signed 64-bit integer; 0 without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - size + 1)
    stops = ends[size - 1 :].tolist() if len(parts) >= size else [len(joined)]
    ones = np.zeros(64, np.int64)
    digest, begins = xxhash.xxh64_intdigest, starts[:n].tolist()
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(begins[at : at + BLOCK], stops[at : at + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)``, one row per row of ``docs``."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), size) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fps], ["doc_id", "text_key", "fp"])

    return source.mapInArrow(run, "doc_id long, text_key long, fp long")


def bits_of(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width, each gathering the bits that correlate most with those it already has."""
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    corr = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(corr, 0)
    left, parts = list(range(bits.shape[1])), []
    for i in range(m):
        width = len(left) // (m - i)
        part = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: corr[b, part].sum()))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def _costs(bits: np.ndarray, part: list[int], total: int, radius: int, probe: float) -> list[float]:
    """Probes (at ``probe`` each) and expected candidates of one fingerprint on a part, for t = -1 .. radius."""
    w, n = len(part), max(2, len(bits))
    keys = bits[:, part].astype(np.uint64) @ (np.uint64(1) << np.arange(w, dtype=np.uint64)) if len(bits) else np.zeros(0, np.uint64)
    values, freq = np.unique(keys, return_counts=True)
    share = float((freq * (freq - 1)).sum()) / (n * (n - 1)) + 2.0**-w
    near = 0.0
    for b in range(w if len(values) else 0):
        at = np.minimum(np.searchsorted(values, values ^ np.uint64(1 << b)), len(values) - 1)
        near += float((freq * freq[at] * (values[at] == values ^ np.uint64(1 << b))).sum()) / n**2 + 2.0**-w
    costs, probes, reach = [0.0], 1.0, share
    for t in range(radius + 1):
        if t == 1:
            probes, reach = probes + w, share + near
        elif t > 1:
            probes, reach = probes * w / t, reach * w / t
        costs.append(probe * probes + reach * total)
    return costs


def plan_parts(bits: np.ndarray, total: int, radius: int, probe: float = 1.0) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of the parts to probe, of least estimated cost; ``bits`` are the rows of a sample."""
    width, best = bits.shape[1], (float("inf"), [])
    most = 1 if width > 64 else radius  # flips of one bit, or of up to the radius on parts of at most 8 bits
    for m in range(max(2, -(-(radius + 1) // (most + 1))), radius + 3):
        parts = _group_bits(bits.astype(float), m) if len(bits) > 1 else [[b for b in range(width) if b % m == i] for i in range(m)]
        table = {0: (0.0, [])}  # units of (t + 1) given out so far -> cost, thresholds
        for part in parts:
            costs, after = _costs(bits, part, total, radius, probe), {}
            for given, (cost, taken) in table.items():
                for t in range(-1, min(most, 1 if len(part) > 8 else radius) + 1):
                    key, now = given + t + 1, cost + costs[t + 1]
                    if key <= radius + 1 and now < after.get(key, (float("inf"),))[0]:
                        after[key] = (now, [*taken, t])
            table = after
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            cost, taken = table[radius + 1]
            best = (cost, [(p, t) for p, t in zip(parts, taken) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(u, v)`` over distinct fingerprints ``fp``; their components are those of all links within ``radius`` (1 or 2)."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    total = distinct.count()
    sample = np.array(
        [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64
    )
    index, probe, flipped = [], [], []
    for i, (part, t) in enumerate(plan_parts(bits_of(sample), total, radius)):
        if t >= 1:
            flipped.append(i)
        key = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in part))))
        flips = [0, *([1 << b for b in part] if t >= 1 else [])]
        if t >= 2:
            flips += [1 << a | 1 << b for a in part for b in part if a < b]
        index.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
        mask = _signed(sum(1 << b for b in part))
        probe += [F.struct(F.lit(i).alias("part"), F.lit(mask).alias("mask"), F.lit(_signed(x)).alias("flip")) for x in flips]
    indexed = distinct.select(F.inline(F.array(*index)), F.col("fp").alias("v"))
    # The probes are one constant array; as many expressions would make generated code that takes long to compile.
    probes = distinct.select(F.col("fp").alias("u"), F.inline(F.array(*probe)))
    probes = probes.select("u", "part", F.col("u").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("own"))
    # An unflipped probe meets itself, so it needs a second member; one alone in its bucket is found by flipped probes.
    sizes = indexed.groupBy("part", "key").agg(F.count("*").alias("members")).where((F.col("members") > 1) | F.col("part").isin(flipped))
    sized = probes.join(sizes, ["part", "key"]).where((F.col("members") > 1) | ~F.col("own")).drop("own")
    sized = materialize(sized, "probes", total * len(probe))
    pairs = (
        sized.where(F.col("members") <= BUCKET)
        .join(indexed, ["part", "key"])
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
        .select("u", "v")
    )
    crowded = sized.where(F.col("members") > BUCKET).select(F.col("u").alias("fp")).distinct()
    around = [0, *(1 << b for b in range(64))] if radius == 2 else [0]
    meet = crowded.select("fp", F.explode(F.array(*[F.lit(_signed(x)) for x in around])).alias("x"))
    meet = meet.select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
    if radius == 1:  # neighbours meet at one of the two values themselves
        flips = F.array(*[F.lit(_signed(1 << b)) for b in range(64)])
        near = crowded.select(F.col("fp").alias("u"), F.explode(flips).alias("x"))
        near = near.select("u", F.col("u").bitwiseXOR(F.col("x")).alias("v"))
        stars = near.join(crowded.select(F.col("fp").alias("v")), "v", "left_semi").where("u < v").select("u", "v")
    else:
        met = meet.groupBy("z").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
        stars = met.select(F.explode("near").alias("u"), F.array_min("near").alias("v")).where("u <> v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)``, one row per row of ``docs``; component_id is the least id reachable.

    Null and wordless texts have fingerprint 0 and are linked like any other. A null id takes part, but is no
    component_id unless its component has no other. Repeated rows give repeated rows. Other columns are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", prints.count())
    return _classes(prints, distinct, links(distinct, radius))


def _classes(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    # Both sides are read back, so that a large component's rows can be split where they are joined.
    many = distinct.count()
    rooted = materialize(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted", many)
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least", many)
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id")


def wide_fingerprint(text: str | None) -> bytes:
    """SimHash of the distinct words of the whole text; zeros without words."""
    parts = list(set((text or "").encode().lower().split()))
    ones, n = np.zeros(64 * WIDE, np.int64), len(parts)
    if not n:
        return bytes(8 * WIDE)
    spread = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, BLOCK // WIDE):
        h = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts[at : at + BLOCK // WIDE]), np.uint64)
        h = h[:, None] + spread
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def slots_of(bits: np.ndarray, plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """``(slots, flipped)``: a row of slots for each fingerprint, its own key of each part and those within the part's threshold.

    A slot is the part's number and a key, so equal slots are equal keys. ``flipped`` tells which columns are probes.
    """
    columns, flipped = [], []
    for i, (part, t) in enumerate(plan):
        place = np.int64(1) << np.arange(len(part), dtype=np.int64)
        key = bits[:, part].astype(np.int64) @ place | np.int64(i) << 48
        for k in range(t + 1):
            for some in itertools.combinations(place.tolist(), k):
                columns.append(key ^ np.int64(sum(some)))
                flipped.append(k > 0)
    return np.stack(columns, axis=1), np.array(flipped)


def forest(f: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect all rows ``f (n, words)`` that are linked within ``limit`` bits, without comparing all pairs.

    A pivot takes all rows left within the limit of it. Two pivots' rows are compared only if the pivots are not connected
    yet and within three limits of each other (the triangle inequality rules out the others), and until a link is found.
    """
    left, u, v, pivots, balls = np.arange(len(f)), [], [], [], []
    while len(left):
        near = np.bitwise_count(f[left] ^ f[left[0]]).sum(axis=1, dtype=np.int64) <= limit
        ball = left[near]
        u.append(np.full(len(ball) - 1, ball[0]))
        v.append(ball[1:])
        pivots.append(ball[0])
        balls.append(ball)
        left = left[~near]
    own = np.arange(len(pivots))

    def find(i: int) -> int:
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for i in range(len(pivots) - 1):
        d = np.bitwise_count(f[pivots[i + 1 :]] ^ f[pivots[i]]).sum(axis=1, dtype=np.int64)
        for j in (np.flatnonzero(d <= 3 * limit) + i + 1).tolist():
            a, b = find(i), find(j)
            met = a != b and _first_link(f, balls[i], balls[j], limit)
            if met:
                own[max(a, b)] = min(a, b)
                u.append(np.array([met[0]]))
                v.append(np.array([met[1]]))
    return np.concatenate(u), np.concatenate(v)


def _first_link(f: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> tuple[int, int] | None:
    step = max(1, PAIRS // len(y))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        i, j = np.nonzero(np.bitwise_count(f[some][:, None] ^ f[y][None]).sum(axis=2, dtype=np.int64) <= limit)
        if len(i):
            return int(some[i[0]]), int(y[j[0]])
    return None


def slot_links(slot: np.ndarray, probe: np.ndarray, f: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs ``(i, j)`` that link, within ``limit``, the rows of a slot; rows are sorted by slot, its own rows before its probes.

    A probe is compared with the rows that have the slot as their own key; two probes meet elsewhere.
    """
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    sizes = np.diff(np.r_[starts, len(slot)])
    owned = np.add.reduceat((~probe).astype(np.int64), starts)
    u, v, work = [], [], owned * sizes
    small = np.flatnonzero((work > 1) & (work <= BATCHED))
    for some in np.split(small, np.flatnonzero(np.diff(np.cumsum(work[small]) // PAIRS)) + 1) if len(small) else []:
        w = work[some]
        k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        i = np.repeat(starts[some], w) + k // np.repeat(sizes[some], w)
        j = np.repeat(starts[some], w) + k % np.repeat(sizes[some], w)
        near = (np.bitwise_count(f[i] ^ f[j]).sum(axis=1, dtype=np.int64) <= limit) & (i != j)
        u.append(i[near])
        v.append(j[near])
    for g in np.flatnonzero(work > BATCHED).tolist():
        s, e, m = int(starts[g]), int(starts[g] + sizes[g]), int(owned[g])
        hits, step, many = [], max(1, PAIRS // (e - s)), 0
        for at in range(s, s + m, step):
            stop = min(s + m, at + step)
            i, j = np.nonzero(np.bitwise_count(f[at:stop][:, None] ^ f[s:e][None]).sum(axis=2, dtype=np.int64) <= limit)
            hits.append((i + at, j + s))
            many += len(i)
            if many > 4 * (e - s):  # most rows are one group: connect it without its pairs
                a, b = forest(f[s:e], limit)
                hits = [(a + s, b + s)]
                break
        u += [i[i != j] for i, j in hits]
        v += [j[i != j] for i, j in hits]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _unpacked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as words and as bits."""
    f = np.stack([a, b], axis=1).view(np.uint64)
    return f, np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")


def _by_place(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches cut where the first ``keys`` columns change, so that no place is split."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        at = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        same = np.logical_and.reduce([x == x[-1] for x in at])
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1  # the last place may go on in the next batch
        if rest and (cut or any(rest[-1].column(k)[-1].as_py() != at[k][0] for k in range(keys))):
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def stars(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links ``(i, j)`` between rows of ``f`` as one star for each connected set: its least fingerprint and each other one."""
    rows, back = np.unique(np.concatenate((i, j)), return_inverse=True)
    _, first, same = np.unique(f[rows], axis=0, return_index=True, return_inverse=True)
    u, v = np.split(same.ravel()[back.ravel()], 2)
    least = np.arange(len(first))  # unique fingerprints are sorted, so a smaller number is a smaller fingerprint
    while True:
        low = np.minimum(least[u], least[v])
        now = least.copy()
        for ends in (u, v, least[u], least[v]):
            np.minimum.at(now, ends, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    other = np.flatnonzero(least != np.arange(len(least)))
    return rows[first[least[other]]], rows[first[other]]


def _edges(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    if len(i):
        i, j = stars(f, i, j)
    ends = [pa.array(np.ascontiguousarray(f[k][:, w]).view(np.int64)) for k in (i, j) for w in (0, 1)]
    return pa.RecordBatch.from_arrays(ends, ["ua", "ub", "va", "vb"])


_EDGE = "ua long, ub long, va long, vb long"


def _hashed(edges: DataFrame) -> DataFrame:
    return edges.select(F.xxhash64("ua", "ub").alias("u"), F.xxhash64("va", "vb").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def wide_links(nodes: DataFrame, limit: int | None = None, crowd: int | None = None, total: int | None = None) -> DataFrame:
    """Edges ``(u, v)`` over ``nodes(fp, a, b)`` whose components are those of all pairs within ``limit`` bits (``LIMIT``).

    ``total`` is the number of fingerprints that the parts are planned for, by default theirs; it changes cost only. Slots
    that a sample shows to hold more than ``crowd`` rows (or a thousandth of all) are dealt over places by hash; rows in
    different places of a slot that the first pass left in different components meet in a second.
    """
    spark, many = nodes.sparkSession, nodes.count()
    limit, crowd = limit or LIMIT, crowd or CROWD
    sample = nodes.select("a", "b").orderBy(F.xxhash64("a", "b"), "a").limit(SAMPLE).toArrow()
    _, bits = _unpacked(sample.column(0).to_numpy(), sample.column(1).to_numpy())
    plan = plan_parts(bits, total or many, limit, PROBE)
    slots, counts = np.unique(slots_of(bits, plan)[0], return_counts=True)
    places = np.ceil(counts * (many / max(1, len(bits))) / max(crowd, many // 1000)).astype(np.int64)
    hot = spark.sparkContext.broadcast((slots[places > 1], places[places > 1], plan))  # at most a thousand slots of each column

    def post(batches: Iterator[pa.RecordBatch], only_hot: bool) -> Iterator[pa.RecordBatch]:
        crowded, dealt, parts = hot.value
        for b in batches:
            for at in range(0, len(b), 2048):
                some = b.slice(at, 2048)
                f, bits = _unpacked(some.column(0).to_numpy(), some.column(1).to_numpy())
                found, flipped = slots_of(bits, parts)
                row, n = np.repeat(np.arange(len(f)), found.shape[1]), np.ones(found.size, np.int64)
                slot, probe = found.ravel(), np.tile(flipped, len(f))
                if len(crowded):
                    near = np.minimum(np.searchsorted(crowded, slot), len(crowded) - 1)
                    n = np.where(crowded[near] == slot, dealt[near], 1)
                place = ((f[row, 0] ^ f[row, 1]) % n.astype(np.uint64)).astype(np.int32)
                if only_hot:
                    kept = n > 1
                    slot, probe, row, place, n = slot[kept], probe[kept], row[kept], place[kept], n[kept]
                columns = [slot, place, probe, f[row, 0].view(np.int64), f[row, 1].view(np.int64), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[: 6 if only_hot else 5]], ["slot", "place", "probe", "a", "b", "n"][: 6 if only_hot else 5])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_place(batches, 2):
            slot, place, probe, a, b = (c.to_numpy() for c in t.columns[:5])
            f, _ = _unpacked(a, b)
            yield _edges(f, *slot_links(slot * 8191 + place, probe, f, limit))

    kinds = "slot long, place int, probe boolean, a long, b long"
    posted = nodes.select("a", "b").mapInArrow(lambda it: post(it, False), kinds)
    met = posted.repartition("slot", "place").sortWithinPartitions("slot", "place", "probe")
    first = materialize(_hashed(met.mapInArrow(compare, _EDGE)), "links")
    if not (places > 1).any():
        return first
    again = nodes.select("a", "b").mapInArrow(lambda it: post(it, True), kinds + ", n int").withColumn("fp", F.xxhash64("a", "b"))
    roots = connected_components(first).withColumnRenamed("node", "fp")
    rooted = materialize(again.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).drop("fp"), "crowded")
    most = rooted.groupBy("slot", "root").agg(F.count("*").alias("k")).groupBy("slot").agg(F.max_by("root", F.struct("k", "root")).alias("most"))
    minor = rooted.join(most, "slot").where("root <> most").withColumn("own", F.col("place"))
    minor = minor.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("place <> own")
    both = rooted.select("slot", "place", F.lit(False).alias("guest"), "a", "b", "root").unionByName(minor.select("slot", "place", F.lit(True).alias("guest"), "a", "b", "root"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_place(batches, 2):
            slot, place, guest, a, b, root = (c.to_numpy() for c in t.columns)
            f, _ = _unpacked(a, b)
            starts = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (place[1:] != place[:-1])])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(slot)]):
                m = s + int((~guest[s:e]).sum())
                for at in range(m, e, step := max(1, PAIRS // max(1, m - s))):
                    stop = min(e, at + step)
                    near = np.bitwise_count(f[at:stop][:, None] ^ f[s:m][None]).sum(axis=2, dtype=np.int64) <= limit
                    i, j = np.nonzero(near & (root[at:stop][:, None] != root[s:m][None]))
                    _, one = np.unique(np.stack([root[at:stop][i], root[s:m][j]], axis=1), axis=0, return_index=True)
                    yield _edges(f, i[one] + at, j[one] + s)  # one link of two components is enough

    more = both.repartition("slot", "place").sortWithinPartitions("slot", "place", "guest").mapInArrow(visit, _EDGE)
    return first.unionByName(_hashed(more))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`near_duplicates`, by wide fingerprints; ``fp`` is a hash of one. Odd input has the same results."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = np.frombuffer(b"".join(wide_fingerprint(t.as_py()) for t in b.column(1)), np.int64).reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(wide[:, 0]), pa.array(wide[:, 1])], ["doc_id", "text_key", "a", "b"])

    prints = source.mapInArrow(run, "doc_id long, text_key long, a long, b long").withColumn("fp", F.xxhash64("a", "b"))
    prints = materialize(prints, "wide")
    distinct = prints.groupBy("fp", "a", "b").agg(F.min("doc_id").alias("least"))
    distinct = materialize(distinct, "distinct", prints.count())
    return _classes(prints.drop("a", "b"), distinct.select("fp", "least"), wide_links(distinct.select("fp", "a", "b")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes_of: Callable = near_duplicates) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component (least id, then text key).

    ``classes_of`` is :func:`near_duplicates` or :func:`similar`.
    """
    classes = materialize(classes_of(docs, id_col, text_col), "classes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    group = [
        F.col("component_id").isNull().alias("g0"),
        F.coalesce("component_id", F.lit(0)).alias("g1"),
        F.when(F.col("component_id").isNull(), F.col("fp")).otherwise(F.lit(0)).alias("g2"),
    ]
    kept = classes.groupBy(*group).agg(F.min(first).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__kerb_id"), F.col("k.text_key").alias("__kerb_key"))
    keyed = docs.withColumns({"__kerb_id": F.col(id_col).cast("long"), "__kerb_key": text_key(F.col(text_col))})
    found = keyed.join(kept, same_row(keyed, kept, ["__kerb_id", "__kerb_key"]), "left_semi")
    if not classes.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).isEmpty():
        order = Window.partitionBy("__kerb_id", "__kerb_key").orderBy("__kerb_key")
        found = found.withColumn("__kerb_n", F.row_number().over(order)).where("__kerb_n = 1")
    return found.select(*docs.columns)
