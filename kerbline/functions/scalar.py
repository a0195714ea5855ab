"""Scalar and aggregate expressions of the feature groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Road classes in order of matching (fixed values).
ROAD_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "pedestrian", "residential", "living_street", "service", "bridleway",
    "footway", "path", "steps", "track", "corridor", "elevator", "cycleway",
)


def road_class(highway: Column) -> Column:
    """The first class whose name the lower-cased value contains, or null."""
    low = F.lower(highway.cast("string"))
    return F.coalesce(*[F.when(F.contains(low, F.lit(c)), F.lit(c)) for c in ROAD_CLASSES])


def one_hot(value: Column, vocabulary: tuple[str, ...], prefix: str, suffix: str = "") -> list[Column]:
    """An indicator (0 or 1) for each word, and one for all others."""
    flags = [F.coalesce((value == v).cast("tinyint"), F.lit(0).cast("tinyint")).alias(f"{prefix}{v}{suffix}") for v in vocabulary]
    return [*flags, (~F.coalesce(value.isin(*vocabulary), F.lit(False))).cast("tinyint").alias(f"{prefix}other{suffix}")]


def vocabulary_code(value: Column, vocabulary: tuple[str, ...], other: int | None = None) -> Column:
    """The word's index; ``other`` (one past the last by default) for anything else, null included."""
    pairs = [x for i, v in enumerate(vocabulary) for x in (F.lit(v), F.lit(i))]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(value, F.lit(""))], F.lit(len(vocabulary) if other is None else other))


def ratio(n: Column, d: Column, default: float = 0.0) -> Column:
    """``n / d``, or the default where d is not above 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(default))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def finite(value: Column, default: float = 0.0) -> Column:
    """Null, NaN and infinities replaced."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(value)


def to_number(value: Column) -> Column:
    """A double, or null for what is none."""
    return value.try_cast("double")


def gini(values: Column) -> Column:
    """Gini coefficient of an aggregated column: finite and positive values only; 0 for fewer than two."""
    good = F.array_sort(F.collect_list(F.when((value := values.cast("double")) > 0, F.when(value < float("inf"), value))))
    n = F.size(good)
    total = F.aggregate(good, F.lit(0.0), lambda s, v: s + v)
    ranked = F.aggregate(F.transform(good, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return F.when((n >= 2) & (total > 0), 2 * ranked / (n * total) - (n + 1) / n).otherwise(F.lit(0.0))


def entropy(counts: list[Column]) -> Column:
    """Shannon entropy (natural) of the shares of non-negative counts; empty bins add nothing."""
    every, zero = F.array(*counts), F.lit(0.0)  # as an array, so that many bins do not make a long method
    total = F.aggregate(every, zero, lambda s, c: s + c)
    part = lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    shares = lambda t: F.when(t > 0, F.aggregate(every, zero, lambda s, c: s + part(c / t))).otherwise(zero)
    return F.get(F.transform(F.array(total), shares), 0)  # so that the total is worked out once, and not for each bin


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cell_index(value: Column, origin: float, step: float) -> Column:
    """Row or column of a coordinate in a raster with that origin and (signed) step."""
    return F.floor((value - origin) / step).cast("int")
