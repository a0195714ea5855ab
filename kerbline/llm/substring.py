"""Exact substring dedup of word windows with a compressed FM-index per shard.

A window is ``size`` consecutive words of one document; a word goes if a window that covers it also starts earlier
(smaller id, then row key, then position). Equal windows have equal anchors: the least hash of the ``GRAM``-word sequences
inside. So a document falls into segments, runs of windows with one anchor, and a window can only repeat in segments of
the same anchor. Segments of anchors that occur once are dropped after one shuffle of hashes, equal segments collapse to
their earliest, and only different segments of one anchor send their words to a shard. A shard holds the segments of
whole anchors, about ``SHARD`` words. Its FM-index is a wavelet matrix over the Burrows-Wheeler transform: packed bits and
a count for each 64 of them. Segments are streamed against it by backward search; windows found in full report their
suffix interval, whose earliest start decides. An anchor with more than ``CROWD`` different segments (the edge of a passage
in very many documents) is cut into single windows, which collapse by content before they are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import row_key, same_row
from kerbline.runtime import drop, materialize

GRAM, SHARD, CROWD = 5, 300_000, 2000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def anchors(words: list[bytes], size: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(anchor, content, start, count)`` of the segments of a document; content hashes all words of a segment."""
    n = len(words)
    if n < size:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    h = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n))
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(h * powers)))
    undo = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _INVERSE))))
    grams = _mix((sums[gram:] - sums[:-gram]) * undo[: n - gram + 1])
    least = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1).argmin(axis=1)
    at = least + np.arange(n - size + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [n - size + 1])))
    content = _mix((sums[first + count + size - 1] - sums[first]) * undo[first] + count.astype(np.uint64))
    return grams[at[first]], content, first, count


class FMIndex:
    """Backward search over symbols 1..sigma with separators 0, on a wavelet matrix of packed bits."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        self.sa = self._suffixes(text)
        bwt = text[self.sa - 1]  # index -1 is the last separator
        self.levels = max(1, int(text.max()).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=(1 << self.levels) + 1))))
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (bwt >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32))
            self.zeros.append(n - int(bits.sum()))
            bwt = np.concatenate((bwt[bits == 0], bwt[bits == 1]))

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        n, rank, step = len(text), text.astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (n + 2 + int(rank.max())) + after if step == 1 else rank * (n + 2) + after
            order = key.argsort(kind="stable")
            new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            step *= 2

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        at, low = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.counts[k][at] + np.bitwise_count(self.words[k][at] & mask).astype(np.int64)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` followed by what ``[lo, hi)`` stands for."""
        both, start = np.concatenate((lo, hi)), np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self._ones(k, np.concatenate((both, start)))
            where = np.concatenate((both, start))
            moved = np.where(np.tile(bit, 3), self.zeros[k] + ones, where - ones)
            both, start = moved[: len(both)], moved[len(both) :]
        n = len(symbol)
        base = self.before[symbol]
        return base + both[:n] - start, base + both[n:] - start


def earlier_windows(segments: list[list[bytes]], order: np.ndarray, starts: np.ndarray, size: int) -> list[int]:
    """For each segment a bit mask of its windows that some segment holds at an earlier place.

    The places of a segment's windows are ``(order, starts + position)``; bit j is the window that starts at word j.
    """
    lengths = np.array([len(s) for s in segments])
    _, symbols = np.unique(np.array([w for s in segments for w in s], dtype=object), return_inverse=True)
    heads = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[heads + lengths] = False
    text[inside] = symbols + 1
    index = FMIndex(text)
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    place = (order[owner].astype(np.int64) << 32) + starts[owner] + np.arange(len(text)) - heads[owner]
    counts = np.maximum(lengths - size + 1, 0)
    seg = np.repeat(np.arange(len(segments)), counts)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = heads[seg] + offset
    lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), len(text), np.int64)
    live = np.arange(len(seg))
    for k in range(size - 1, -1, -1):  # a window that is alone already needs no more steps
        lo[live], hi[live] = index.step(text[at[live] + k], lo[live], hi[live])
        live = live[hi[live] - lo[live] > 1]
    masks = [0] * len(segments)
    if len(live):
        places = np.append(place[index.sa], np.iinfo(np.int64).max)
        spans, back = np.unique(np.stack([lo[live], hi[live]], axis=1), axis=0, return_inverse=True)
        least = np.minimum.reduceat(places, spans.ravel())[::2][back.ravel()]
        for w in live[least < place[at[live]]]:
            masks[seg[w]] |= 1 << int(offset[w])
    return masks


def _posts(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, rows = [], []
            for i, text in enumerate(b.column(2)):
                got = anchors(tokens(text.as_py()), size)
                parts.append(got)
                rows.append(np.full(len(got[0]), i))
            if not parts:
                continue
            h, content, start, count = (np.concatenate(p) for p in zip(*parts))
            at = pa.array(np.concatenate(rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(start << 8 | count)],
                ["h", "content", "id", "key", "at"],
            )

    return docs.mapInArrow(run, "h long, content long, id long, key int, at long")


def _pieces(docs: DataFrame, lists: DataFrame, size: int) -> DataFrame:
    """The words of the listed segments: ``(h, content, segment binary, id, key, at)``."""
    joined = docs.join(lists, same_row(docs, lists, ["id", "key"])).select(docs["id"], docs["key"], "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows = [], []
            for i, (text, wanted) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                words = tokens(text.as_py())
                for w in wanted:
                    start, count = w["at"] >> 8, w["at"] & 255
                    out.append((w["h"], w["content"], b" ".join(words[start : start + count + size - 1]), w["at"]))
                    rows.append(i)
            h, content, segment, at = zip(*out) if out else ((),) * 4
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(content, pa.int64()), pa.array(segment, pa.binary()), b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int64())],
                ["h", "content", "segment", "id", "key", "at"],
            )

    return joined.mapInArrow(run, "h long, content long, segment binary, id long, key int, at long")


def _search(pieces: DataFrame, size: int) -> DataFrame:
    """``(h, content, mask)``: windows of each segment that stand earlier in another; mask 0 is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        held = 0

        def report() -> pa.RecordBatch:
            ids = np.array([(-(1 << 63) if r[3] is None else r[3]) for r in shard], np.int64)
            keys = np.array([r[4] for r in shard], np.int64)
            _, order = np.unique(np.stack([ids, keys], axis=1), axis=0, return_inverse=True)
            masks = earlier_windows([r[2].split() for r in shard], order.ravel(), np.array([r[5] >> 8 for r in shard]), size)
            found = [(r[0], r[1], m) for r, m in zip(shard, masks) if m]
            h, content, mask = zip(*found) if found else ((),) * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, content, mask)], ["h", "content", "mask"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held > SHARD and row[0] != shard[-1][0]:
                    yield report()
                    shard, held = [], 0
                shard.append(row)
                held += row[2].count(b" ") + 1
        if shard:
            yield report()

    return pieces.mapInArrow(run, "h long, content long, mask long")


def _by_window(pieces: DataFrame, size: int) -> DataFrame:
    """What :func:`_search` returns, for the segments of crowded anchors: windows collapse by content first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, text, nth = [], [], []
            for i, segment in enumerate(b.column(2).to_pylist()):
                words = segment.split()
                for j in range(len(words) - size + 1):
                    rows.append(i)
                    nth.append(j)
                    text.append(hashlib.blake2b(b" ".join(words[j : j + size]), digest_size=16).digest())
            take = pa.array(rows, pa.int64())
            kept = [b.column(k).take(take) for k in (0, 1, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(nth, pa.int32()), pa.array(text, pa.binary())], ["h", "content", "id", "key", "at", "nth", "window"])

    rows = pieces.mapInArrow(run, "h long, content long, id long, key int, at long, nth int, window binary")
    rows = materialize(rows, "windows")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "key", (F.shiftright("at", 8) + F.col("nth")).alias("start"))
    first = rows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = rows.join(first, "window").where(F.col("first") < place)
    bit = F.expr("shiftleft(1L, nth)")
    return later.groupBy("h", "content").agg(F.bit_or(bit).alias("mask"))


def removals(docs: DataFrame, size: int) -> DataFrame:
    """``(id, key, marks array<long>)`` for ``docs(id, key, text)``; a mark is a segment's start << 32 | mask of windows."""
    # Counts are combined before the shuffle and joined back, so that an anchor in very many documents meets in no task.
    every = materialize(_posts(docs.select("id", "key", "text"), size), "anchors")
    # What is joined is read back first: a join straight after a grouping could not split a crowded key.
    shared = materialize(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    posts = materialize(every.join(shared, "h", "left_semi"), "posts")
    drop(every)
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "key", "at")
    firsts = posts.groupBy("h", "content").agg(F.min(place).alias("first"))
    firsts = materialize(firsts.select("h", "content", "first.id", "first.key", "first.at"), "firsts")
    variants = materialize(firsts.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1"), "variants")
    matched = firsts.join(variants, "h")
    lists = matched.groupBy("id", "key").agg(F.collect_list(F.struct("h", "content", "at")).alias("wanted"))
    pieces = materialize(_pieces(docs.select("id", "key", "text"), lists, size), "segments")
    pieces = pieces.join(variants, "h")
    few = pieces.where(F.col("variants") <= CROWD).drop("variants")
    masks = _search(few.repartition("h").sortWithinPartitions("h"), size)
    masks = masks.unionByName(_by_window(pieces.where(F.col("variants") > CROWD).drop("variants"), size))
    masks = materialize(masks, "masks")
    earliest = firsts.join(masks, ["h", "content"], "left")
    earliest = earliest.select("h", "content", F.struct(F.col("id").isNotNull().alias("known"), "id", "key", "at").alias("first"), "mask")
    earliest = materialize(earliest, "earliest")
    marked = posts.join(earliest, ["h", "content"]).select(
        "id",
        "key",
        F.shiftright("at", 8).alias("start"),
        F.when(place == F.col("first"), F.coalesce("mask", F.lit(0))).otherwise(F.expr("shiftleft(1L, cast(at & 255 as int)) - 1")).alias("mask"),
    )
    mark = F.shiftleft(F.col("start"), 32).bitwiseOR(F.col("mask"))
    return marked.where("mask > 0").groupBy("id", "key").agg(F.collect_set(mark).alias("marks"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``, one row per row of ``docs``; the kept words are joined by one space.

    A null text has no words. A null id counts as smallest; rows with one id are told apart, and ordered, by a hash of
    their text, and rows alike in both are one document with one result each. Other columns are not read. ``size`` is at
    most 32.
    """
    if not GRAM < size <= 32:
        raise ValueError(f"size must be in {GRAM + 1}..32")
    source = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    gone = removals(source, size)
    joined = source.join(gone, same_row(source, gone, ["id", "key"]), "left").select(source["id"], "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cut, kept = [], [], []
            for text, marks in zip(b.column(1), b.column(2)):
                words = tokens(text.as_py())
                marks = marks.as_py()
                if marks:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for m in marks:
                        start, mask = m >> 32, m & 0xFFFFFFFF
                        while mask:
                            j = (mask & -mask).bit_length() - 1
                            edge[start + j] += 1
                            edge[start + j + size] -= 1
                            mask &= mask - 1
                    keep = np.cumsum(edge)[:-1] == 0
                    left = [w for w, k in zip(words, keep.tolist()) if k]
                else:
                    left = words
                n.append(len(words))
                cut.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"]
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
