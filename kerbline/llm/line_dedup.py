"""Deletion of repeated lines by hashes of windows of lines. DataFrame functions only.

A document is the sequence of its lines that hold a word. A line goes if it lies in a run of ``window`` consecutive
lines that also starts earlier (smaller id, then text key, then position), or if it alone has ``solo_chars``
characters or more and also stands earlier. Winnowing finds them: of each window of lines the least line hash is selected, and
each selected line is posted once, so two equal runs of ``window`` lines share a posting. A posting carries what it extends
to: 128-bit hashes of the windows that selected it, from the one that ends with it to the one that starts with it. Postings
are joined on the selected hash; those with a partner are extended both ways, and a window is confirmed by the earliest equal
one. Runs are the union of confirmed windows. Hashes stand for contents: two unequal windows are taken as equal with a
chance of 2^-128 a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import SPACES, row_key, same_row
from kerbline.runtime import drop, materialize


def _hashes(*parts: Column) -> Column:
    """128 bits: two hashes of the same values from different seeds."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _full_lines(text: Column) -> Column:
    """The lines that hold a word, without white space at their ends."""
    return F.filter(F.transform(_lines(text), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def removed_lines(docs: DataFrame, id_col: str, text_col: str, window: int, solo_chars: int) -> DataFrame:
    """``(id, key, gone)``: which of the lines with a word go, counted from 0; rows without any are absent."""
    text, w = F.col(text_col), window
    line = F.transform(_full_lines(text), lambda x: F.struct(_hashes(x).alias("h"), (F.length(x) >= solo_chars).alias("solo")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(text).alias("key"), line.alias("a"))
    rows = rows.select("id", "key", "a", F.transform("a", lambda x: x["h"]).alias("hs"), F.size("a").alias("n"))
    starts = F.when(F.col("n") >= w, F.sequence(F.lit(0), F.col("n") - w)).otherwise(F.array().cast("array<int>"))
    chosen = lambda i: F.array_min(
        F.transform(F.slice("hs", i + 1, w), lambda h, j: F.struct(h["a"].alias("h"), (i + j).alias("at")))
    )
    rows = rows.withColumn("chosen", F.transform(starts, chosen))
    extent = lambda start, length: F.struct(
        _hashes(F.lit(length), F.slice("hs", start + 1, length)).alias("gram"), start.cast("int").alias("start"), F.lit(length).alias("length")
    )
    # A selected line is chosen by neighbouring windows; the first of them posts it with all of them.
    heads = F.filter(starts, lambda i: (i == 0) | (F.get("chosen", i)["at"] != F.get("chosen", i - 1)["at"]))
    mine = lambda i: F.filter(
        F.sequence(i, F.least(i + (w - 1), F.col("n") - w)), lambda j: F.get("chosen", j)["at"] == F.get("chosen", i)["at"]
    )
    selected = F.transform(heads, lambda i: F.struct(F.get("chosen", i)["h"].alias("f"), F.transform(mine(i), lambda j: extent(j, w)).alias("windows")))
    solos = F.filter(F.transform("a", lambda x, i: F.struct(x["solo"].alias("solo"), x["h"]["a"].alias("f"), F.array(extent(i, 1)).alias("windows"))), lambda x: x["solo"])
    solos = F.transform(solos, lambda x: F.struct(x["f"].alias("f"), x["windows"].alias("windows")))
    posted = materialize(rows.select("id", "key", F.inline(F.concat(selected, solos))), "postings")
    # What is joined is read back first: a join straight after a grouping could not split a crowded key.
    shared = materialize(posted.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "shared")
    met = posted.join(shared, "f", "left_semi").select("id", "key", F.inline("windows"))
    met = materialize(met.select("id", "key", "gram.a", "gram.b", "start", "length"), "met")
    drop(posted)
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "key", "start")
    first = met.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = met.join(materialize(first, "first"), ["a", "b"]).where(place > F.col("first"))
    covers = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1))
    return later.select("id", "key", covers.alias("nth")).groupBy("id", "key").agg(F.collect_set("nth").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, solo_chars: int = 80) -> DataFrame:
    """``docs`` with later repeated lines deleted from the text, and columns ``n_lines`` and ``n_removed``.

    Lines are compared without white space at their ends; lines without a word stay. A null text stays null (0 lines).
    A null id counts as smallest. Rows with the same id and text are one document and lose the same lines. Columns of
    ``docs`` called ``n_lines`` or ``n_removed`` are replaced.
    """
    gone = removed_lines(docs, id_col, text_col, window, solo_chars)
    gone = gone.select(F.col("id").alias("__kerb_id"), F.col("key").alias("__kerb_key"), F.col("gone").alias("__kerb_gone"))
    keyed = docs.withColumns({"__kerb_id": F.col(id_col).cast("long"), "__kerb_key": row_key(F.col(text_col))})
    joined = keyed.join(gone, same_row(keyed, gone, ["__kerb_id", "__kerb_key"]), "left").drop(gone["__kerb_id"]).drop(gone["__kerb_key"])
    count = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    lines = joined.withColumn("__kerb_lines", F.when(F.col("__kerb_gone").isNotNull(), _lines(F.col(text_col))))
    every = F.sequence(F.lit(0), F.size("__kerb_lines") - 1)
    full = F.filter(every, lambda i: F.btrim(F.get("__kerb_lines", i), F.lit(SPACES)) != "")
    lines = lines.withColumn("__kerb_full", F.when(F.col("__kerb_gone").isNotNull(), full))
    kept = F.array_except(every, F.transform("__kerb_gone", lambda g: F.get("__kerb_full", g)))
    text = F.array_join(F.transform(kept, lambda i: F.get("__kerb_lines", i)), "\n")
    out = lines.withColumns(
        {
            text_col: F.when(F.col("__kerb_gone").isNull(), F.col(text_col)).otherwise(text),
            "n_lines": F.coalesce(count, F.lit(0)).cast("long"),
            "n_removed": F.when(F.col("__kerb_gone").isNull(), 0).otherwise(F.size("__kerb_gone")).cast("long"),
        }
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*names, "n_lines", "n_removed")
