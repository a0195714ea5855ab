"""Line-first quality rules. DataFrame functions only, one pass and no shuffle.

Each line with a word is judged alone; failing lines are removed; a document that loses more than ``max_loss`` of its
words is rejected, as is one that fails the base rules on its whole text. A null text has no words and is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import SPACE_RUN, SPACES, count_chars, words

#: A sentence's end, with closing quotes and brackets after it.
ENDING = r"[.!?…。！？؟।:;][\"'”’»)\]}]*[\x20\x09-\x0D]*\z"
#: Characters of symbols, and marks between the entries of a menu, as Java character classes.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›»•·"
#: A line with one of these, in lower case, is boilerplate.
BOILERPLATE = (
    "all rights reserved", "cookie", "javascript", "terms of service", "terms of use", "privacy policy", "licensed under",
    "click here", "subscribe to", "lorem ipsum",
)


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether a line with ``n_words`` words fails a rule. At least one word is assumed."""
    low = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    no_end = (n_words < 20) & ~F.rlike(line, F.lit(ENDING))  # a long paragraph is no fragment
    menu = 5 * count_chars(line, SEPARATORS) >= n_words
    symbols = 10 * count_chars(line, SYMBOLS) >= 3 * n_words
    shouts = (n_words >= 3) & (2 * count_chars(line, "!") >= n_words)
    return no_end | menu | symbols | shouts | phrase


def judge(docs: DataFrame, text_col: str = "text", max_loss: float = 0.5, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text``.

    The added names get ``prefix``, to keep clear of columns of ``docs``; without one, columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    p = {n: f"__kerb_{n}" for n in ("w", "n", "h", "s", "l", "at", "good", "n_good")}
    d = docs.withColumn(p["w"], words(text))
    d = d.withColumn(p["n"], F.size(p["w"]))
    word = lambda i: F.get(p["w"], i)
    starts = F.when(F.col(p["n"]) >= 6, F.sequence(F.lit(0), F.col(p["n"]) - 5)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn(p["h"], F.transform(starts, lambda i: F.xxhash64(*(word(i + k) for k in range(5)))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.transform(p["h"], lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))
    d = d.withColumn(p["s"], F.when(F.size(F.array_distinct(p["h"])) < F.size(p["h"]), F.sort_array(pairs)).otherwise(none))
    d = d.drop(p["h"])
    same = lambda s, j: F.get(p["s"], j)["h"].eqNullSafe(s["h"])
    again = F.filter(p["s"], lambda s, j: same(s, j + 1) | ((j > 0) & same(s, j - 1)))
    d = d.withColumn(p["at"], F.sort_array(F.transform(again, lambda s: s["i"])))
    covered = F.aggregate(
        p["at"],
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 5 - F.greatest(i, acc["end"])).alias("n"), (i + 5).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    line = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    judged = F.transform(line, lambda x: F.struct(x.alias("x"), F.size(words(x)).alias("n")))
    d = d.withColumn(p["l"], judged)
    d = d.withColumn(p["good"], F.filter(p["l"], lambda x: ~line_fails(x["x"], x["n"])))
    left = F.aggregate(p["good"], F.lit(0), lambda acc, x: acc + x["n"])
    d = d.withColumns({p["n_good"]: left, p["at"]: covered})
    new = {
        "n_words": F.col(p["n"]).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long"),
        "n_symbols": count_chars(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(p["l"]) - F.size(F.array_distinct(p["l"]))).cast("long"),
        "n_repeat_words": F.col(p["at"]),
    }
    failed = (F.col(p["n"]) < 10) | (100 * F.col(p["at"]) > 20 * F.col(p["n"]))
    new |= {
        "base_failed": failed,
        "kept": ~failed & (F.col(p["n"]) - F.col(p["n_good"]) <= F.lit(max_loss) * F.col(p["n"])),
        "clean_text": F.array_join(F.transform(p["good"], lambda x: x["x"]), "\n"),
    }
    names = [c for c in docs.columns if c not in {prefix + n for n in new}]
    return d.select(*names, *(v.alias(prefix + n) for n, v in new.items()))


def clean(docs: DataFrame, text_col: str = "text", max_loss: float = 0.5) -> DataFrame:
    """The documents that are kept, with their failing lines removed; same columns."""
    out = judge(docs, text_col, max_loss, "__kerb_out_")
    # A filter on the verdict would be pushed below the steps that make it, and repeat them; a generator is not.
    none = F.array().cast("array<string>")
    text = F.explode(F.when(F.col("__kerb_out_kept"), F.array("__kerb_out_clean_text")).otherwise(none)).alias("__kerb_text")
    kept = out.select(*docs.columns, text)
    return kept.withColumn(text_col, F.col("__kerb_text")).select(*docs.columns)
