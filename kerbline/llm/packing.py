"""Best-fit-decreasing packing of tokenised documents into sequences, with a segment tree over remaining capacities.

Piece lengths are integers up to the capacity, so all pieces of one length are alike: the packer works on the count of
every length (at most ``capacity`` numbers, whatever the corpus holds) and on groups of bins with one remaining
capacity. For lengths from large to small it takes the group with the tightest remaining capacity that fits, which a
segment tree finds in logarithmic time; this is exactly best-fit decreasing over all pieces. The plan lists, for each
length, which ranks go to which bins; pieces get their rank within their length from counts per input partition, so that
no task or key gathers the pieces of one length.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.runtime import materialize

CAPACITY = 2048
#: Runs of one kind of character longer than this go to the reference tokenizer.
LONG_RUN = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(path: str):
    """``str -> list[int]`` for a byte-level BPE file of ``tokenizers``.

    The same vocabulary and merges run in ``tiktoken``, which is four times as fast; where that gives up, and for texts
    with very long runs without a break, ``tokenizers`` itself encodes.
    """
    import json
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level files
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    long_run = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))

    def encode(text: str) -> list[int]:
        if long_run.search(text) is None:
            try:
                return fast.encode(text, allowed_special="all")
            except BaseException as e:  # a panic of the native code is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter than the capacity."""
    first = n % capacity if n > capacity else n
    pieces = [(0, first)] if first else []
    return pieces + [(s, capacity) for s in range(first, n, capacity)] if n > capacity else pieces


class _Tree:
    """A segment tree over remaining capacities 0..n: how many bins have each, and the least one at or above a value."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, on: bool) -> None:
        at += self.size
        self.any[at] = on
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def least(self, low: int) -> int:
        """The least capacity >= low that a bin has, or -1."""
        at = low + self.size
        if self.any[at]:
            return low
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, pieces, first bin, offset)`` of best-fit decreasing; one piece of the run in each bin."""
    tree, groups = _Tree(capacity), {}  # capacity left -> stack of (first bin, bins)
    out, bins = [], 0

    def put(left: int, group: tuple[int, int]) -> None:
        if not groups.setdefault(left, []):
            tree.set(left, True)
        groups[left].append(group)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.least(length)
            if left < 0:  # no open bin fits: open as many as the pieces of this length fill
                n = -(-todo // (capacity // length))
                put(capacity, (bins, n))
                bins += n
                left = capacity
            first, n = groups[left].pop()
            if not groups[left]:
                tree.set(left, False)
            # The tightest bin is filled with this length as long as it stays the tightest: bin by bin, so whole bins
            # take as many pieces as fit, and at most one bin takes fewer.
            fits = left // length
            whole = min(n, todo // fits)
            for k in range(fits if whole else 0):
                out.append((length, rank, whole, first, capacity - left + k * length))
                rank += whole
            todo -= whole * fits
            if whole and left - fits * length:
                put(left - fits * length, (first, whole))
            first, n = first + whole, n - whole
            if n and 0 < todo < fits:
                for k in range(todo):
                    out.append((length, rank, 1, first, capacity - left + k * length))
                    rank += 1
                put(left - todo * length, (first, 1))
                first, n, todo = first + 1, n - 1, 0
            if n:
                put(left, (first, n))
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, capacity: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, task, nth)``; nth counts the pieces of a length within a task."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((i, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), seen[n]))
                    seen[n] += 1
            at = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            out = [pa.array(v, k) for v, k in zip(at[1:5], kinds)] + [pa.array([task] * len(rows), pa.int32()), pa.array(at[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at[0], pa.int64())), *out],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return source.mapInArrow(run, schema)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, capacity: int = CAPACITY
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A null text is an empty one: its end id alone. Repeated rows, and null ids, are documents of their own. No rows give
    no rows. Other columns are not read. The counts that reach the driver are at most ``capacity`` numbers; the plan that
    comes back has a size that depends on them alone.
    """
    made = materialize(pieces(docs, id_col, text_col, path or default_tokenizer(), end_id, capacity), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = materialize(by_task.withColumn("before", F.coalesce(before, F.lit(0))), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    rows = docs.sparkSession.createDataFrame(
        [(int(a), int(b), int(c), int(d), int(e)) for a, b, c, d, e in runs], "length long, first long, n long, bin long, offset long"
    )
    by_length = rows.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "bin", "offset"))).alias("runs"))
    offsets = by_task.select("length", "task", "before").hint("shuffle_hash")  # grows with the tasks: never broadcast
    placed = made.join(offsets, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    placed = placed.join(F.broadcast(by_length), "length")
    at = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["n"]))[0]
    placed = placed.withColumn("at", at)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("at.bin") + F.col("rank") - F.col("at.first")).alias("sequence_id"), F.col("at.offset").alias("offset")
    )
