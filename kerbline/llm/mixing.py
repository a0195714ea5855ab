"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents; the whole part is certain and
the rest p is rounded. Two undecided documents meet and words move from one to the other, at random in either direction
so that each keeps its expectation, until one of them is decided. What is left of a block is one undecided document;
blocks' residuals meet in blocks of the next level, and so on up a tree, so that a source misses its target by less
than one document's words. Blocks hold about ``BLOCK`` rows whatever the size of a source.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import text_key, words
from kerbline.runtime import materialize

#: Rows of one block of the reduction tree.
BLOCK = 4096
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows; only totals reach the driver.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all words; what is above ``cap`` times
    a source's size is shared again among the others by weight, until no source is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    number = (F.row_number().over(order) - 1) % len(weights)
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), number + 1))
    sources = materialize(sources.withColumn("most", cap * F.col("source_size")), "sources")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, before = 0.0, -1
    while True:
        capped = (F.col("w") * F.lit(rate) > F.col("most")) | (F.col("most") <= 0)
        n, full, free = sources.agg(
            F.count_if(capped), F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("w")))
        ).first()
        if n == before or not free:
            break
        before, rate = n, (total - float(full or 0)) / free
    return sources.select("source", "source_size", F.least("most", F.col("w") * F.lit(rate)).alias("target"))


def _settle(p: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int) -> None:
    """Move words between undecided rows, in place, until at most one p is left strictly between 0 and 1."""
    rng = np.random.default_rng([seed & 0xFFFFFFFF, *(int(k) & 0xFFFFFFFFFFFFFFFF for k in key[:1])])
    draws, i = rng.random(len(p)), -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if draws[j] * (up + down) < down else -down
        for k, by in ((i, move), (j, -move)):
            p[k] = p[k] + by / size[k]
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1


def _round_blocks(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """Settle each (src, block); rows come back with p, and ``open`` marks the residual."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "size", "row"], kind="stable", ignore_index=True)
        p = part["p"].to_numpy(float, copy=True)
        _settle(p, part["size"].to_numpy(float), part["key"].to_numpy("int64"), seed + level)
        return part.assign(p=p, open=(p > 0) & (p < 1))

    return rows.groupBy("src", "block").applyInPandas(
        run, "src long, block long, row string, key long, size long, p double, open boolean"
    )


def copies(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``sizes(row, source, size)`` with ``source_size, target, copies``; ``row`` identifies a row and seeds its chance."""
    src = F.xxhash64("source", F.col("source").isNull())
    known = targets.withColumn("src", src).withColumnRenamed("source", "s")
    each = sizes.withColumn("src", src).join(known, "src").drop("s")
    each = each.withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    each = each.withColumns({"whole": F.floor(F.col("r") + 1e-12), "p": F.greatest(F.col("r") - F.floor(F.col("r") + 1e-12), F.lit(0.0))})
    each = materialize(each, "copies")
    key = F.xxhash64("row", F.lit(seed))
    n = each.where("size > 0 and p > 0").groupBy("src").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    now = each.where("size > 0 and p > 0").join(n, "src").select(
        "src", F.pmod(F.xxhash64("row", F.lit(seed + 1)), blocks).alias("block"), "row", key.alias("key"), "size", "p"
    )
    settled, level = None, 0
    most = n.agg(F.max("n")).first()[0] or 0
    while True:
        done = materialize(_round_blocks(now, level, seed), "pivots")
        closed = done.where("not open").select("row", "p")
        settled = closed if settled is None else settled.unionByName(closed)
        most = -(-most // BLOCK)
        if most <= 1:
            break
        now = done.where("open").select("src", F.floor(F.col("block") / BLOCK).alias("block"), "row", "key", "size", "p")
        level += 1
    chance = (F.xxhash64("row", F.lit(seed + 2)).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    last = done.where("open").select("row", F.when(chance < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    extra = settled.unionByName(last).select("row", (F.col("p") > 0.5).cast("long").alias("extra"))
    out = each.join(extra, "row", "left")
    return out.select(*sizes.columns, "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per row of ``docs``; rows alike in id, source and text are told apart by a running number."""
    size = F.size(words(F.col(text_col))).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), text_key(F.col(text_col)).alias("text_key"))
    rows = materialize(rows, "sizes")
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_key", F.xxhash64("source", F.col("source").isNull()))
    rows = rows.withColumn("row", row)
    twins = rows.groupBy("row").count().where("count > 1")
    if twins.limit(1).isEmpty():
        return rows
    alike = Window.partitionBy("row").orderBy("size")
    again = rows.join(twins, "row", "left_semi").withColumn("row", F.concat_ws(":", "row", F.row_number().over(alike)))
    return rows.join(twins, "row", "left_anti").select(*rows.columns).unionByName(again.select(*rows.columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """``(doc_id, text_key, source, size, source_size, target, copies)``, one row per row of ``docs``.

    Size is the number of words (null text: 0); a document without words gets the certain copies only. Reruns agree:
    chance comes from ids and texts, not from the order of rows. Other columns are not read.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "rows")
    return copies(sized, source_targets(sized), seed).drop("row")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    names = ["__kerb_id", "__kerb_key", "__kerb_src"]
    plan = mix(docs, id_col, text_col, source_col, seed)
    same = [F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1]), F.col("source").alias(names[2])]
    plan = plan.groupBy(*same).agg(F.sum("copies").alias("__kerb_n"), F.count("*").alias("__kerb_rows"))
    plan = materialize(plan, "plan")
    keyed = docs.withColumns(dict(zip(names, (F.col(id_col), text_key(F.col(text_col)), F.col(source_col).cast("string")))))
    test = F.lit(True)
    for k in names:
        test = test & keyed[k].eqNullSafe(plan[k])
    joined = keyed.join(plan.where("__kerb_n > 0"), test).select(
        *(keyed[c] for c in docs.columns), *(keyed[k] for k in names), "__kerb_n"
    )
    if not plan.where("__kerb_rows > 1").limit(1).isEmpty():  # rows that are alike count together, at the first of them
        nth = F.row_number().over(Window.partitionBy(*names).orderBy(names[1]))
        joined = joined.withColumn("__kerb_i", nth).where("__kerb_i = 1")
    repeated = joined.withColumn("__kerb_i", F.explode(F.array_repeat(F.lit(0), F.col("__kerb_n").cast("int"))))
    return repeated.select(*docs.columns)
