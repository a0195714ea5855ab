"""What the operators share: words, ASCII case and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words: space and U+0009 to U+000D. ``bytes.split()`` uses the same six.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java pattern of one or more.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def count_chars(text: Column, marks: str) -> Column:
    """How many characters of ``marks`` (a Java character class) a text has; ``translate`` would cost ten times as much."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{marks}]+", ""))


def text_key(text: Column) -> Column:
    """Tells rows of one document id apart; with the id it is the key of a row."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.when(text.isNull(), F.lit(1)).otherwise(F.lit(0)))


def row_key(text: Column) -> Column:
    """The same in 31 bits, for rows that are shuffled in great number: it only tells rows of one id apart."""
    return text_key(text).bitwiseAND(0x7FFFFFFF).cast("int")


def same_row(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys``."""
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(right[k])
    return test
