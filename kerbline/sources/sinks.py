"""Sinks: feature tables as Parquet or CSV, features as GeoJSON. Nothing overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str) -> None:
    """The canonical sink."""
    df.write.mode("overwrite").parquet(path)


def write_feature_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """A folder of CSV parts with a header; doubles are rounded half to even."""
    rounded = [F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).write.mode("overwrite").csv(path, header=True)


def to_geojson(df: DataFrame, coords: str = "coords") -> DataFrame:
    """One GeoJSON feature per row, as text; all other columns are properties."""
    pair = F.transform(coords, lambda c: F.array(c["x"], c["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), pair.alias("coordinates"))
    rest = F.struct(*[c for c in df.columns if c != coords])
    feature = F.struct(F.lit("Feature").alias("type"), rest.alias("properties"), geometry.alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, coords: str = "coords") -> None:
    """Newline-delimited features, written in parallel."""
    to_geojson(df, coords).write.mode("overwrite").text(path)
