"""Vector sources: GeoJSON, shapefiles, CSV and Parquet extracts. All read through Spark, so any store that it knows works."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.relational import first_column, quantiles

#: Heights of buildings: columns in order of preference (fixed values); names with one of ``LEVELS`` count storeys.
HEIGHT_COLUMNS = (
    "height", "Height", "HEIGHT", "bldg_h", "bldg_height", "H_m", "h_m", "h", "HGT", "max_h", "mean_h", "levels", "Levels", "floors",
    "Floors",
)
LEVELS = ("level", "floor")
STOREY = 3.0


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """LineString features as ``(properties.., coords array<struct<x, y>>)``; features without coordinates are dropped."""
    feature = f"struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: array<array<double>>>>"
    raw = spark.read.option("multiLine", True).schema(f"features array<{feature}>").json(path)
    d = raw.select(F.inline("features")).where(F.size("geometry.coordinates") > 0)
    coords = F.transform("geometry.coordinates", lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y")))
    return d.select("properties.*", coords.alias("coords"))


def read_boundary(spark: SparkSession, path: str) -> list[list[tuple[float, float]]]:
    """The rings of the polygons of a GeoJSON file, which should not overlap; one boundary fits the driver by nature."""
    geometry = "struct<type: string, coordinates: string>"
    raw = spark.read.option("multiLine", True).schema(f"features array<struct<geometry: {geometry}>>").json(path)
    rows = raw.select(F.inline("features")).select("geometry.type", "geometry.coordinates").collect()
    rings = []
    for kind, text in rows:
        if kind in ("Polygon", "MultiPolygon"):
            polygons = [json.loads(text)] if kind == "Polygon" else json.loads(text)
            rings += [[(float(c[0]), float(c[1])) for c in ring] for polygon in polygons for ring in polygon]
    if not rings:
        raise ValueError(f"no polygon in {path}")
    return rings


def read_csv_tables(spark: SparkSession, paths: Sequence[str], key: str = "id") -> list[DataFrame]:
    """The CSV tables that have the key column, in order of path; a byte-order mark is skipped by the reader."""
    tables = [spark.read.csv(p, header=True, inferSchema=True) for p in sorted(paths)]
    return [t for t in tables if key in t.columns]


def read_points(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float, box: str = "bbox") -> DataFrame:
    """A Parquet extract by bounding box; the test on the nested columns reaches the scan."""
    inside = F.col(f"{box}.xmin").between(xmin, xmax) & F.col(f"{box}.ymin").between(ymin, ymax)
    return spark.read.parquet(path).where(inside)


def poi_extract(places: DataFrame) -> DataFrame:
    """Name, two category levels and position: first and second entry of the category path (null if absent), the point itself."""
    path, at = F.col("taxonomy.hierarchy"), wkb_point(F.col("geometry"))
    return places.select(
        F.coalesce("names.primary", F.lit("")).alias("name"), F.get(path, 0).alias("cat_l1"), F.get(path, 1).alias("cat_l2"),
        at["y"].alias("lat"), at["x"].alias("lon"),
    )


def wkb_point(geometry: Column) -> Column:
    """``struct<x, y>`` of a point in well-known binary of either byte order; null for what is no point."""
    hexed = F.hex(geometry)
    little = F.substring(hexed, 1, 2) == "01"
    word = lambda at: F.substring(hexed, at, 16)
    turned = lambda w: F.concat(*[F.substring(w, 15 - 2 * i, 2) for i in range(8)])

    def number(at: int) -> Column:
        """The double of 16 hexadecimal digits, exactly: sign, exponent and fraction."""
        w = F.when(little, turned(word(at))).otherwise(word(at))
        high = F.conv(F.substring(w, 1, 8), 16, 10).cast("long")
        low = F.conv(F.substring(w, 9, 8), 16, 10).cast("long")
        exponent = F.shiftright(high, 20).bitwiseAND(0x7FF)
        fraction = (high.bitwiseAND(0xFFFFF) * F.lit(1 << 32) + low) / float(1 << 52)
        size = F.when(exponent == 0, fraction * 2.0**-1022).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))
        return F.when(high >= 1 << 31, -size).otherwise(size)

    kind = F.when(little, F.substring(hexed, 3, 8) == "01000000").otherwise(F.substring(hexed, 3, 8) == "00000001")
    return F.when(kind & (F.octet_length(geometry) >= 21), F.struct(number(11).alias("x"), number(27).alias("y")))


def parse_shapes(data: bytes) -> list[tuple[int, list[list[tuple[float, float]]]]]:
    """``(record number, parts)`` of the points, lines and polygons of a .shp file."""
    out, at = [], 100
    while at + 12 <= len(data):
        number, words = struct.unpack(">2i", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 1:
            out.append((number, [[struct.unpack("<2d", body[4:20])]]))
        elif kind in (3, 5):
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            points = list(zip(flat[::2], flat[1::2]))
            out.append((number, [points[a:b] for a, b in zip(starts, starts[1:])]))
        at += 8 + 2 * words
    return out


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """``(path, record, rings array<array<struct<x, y>>>)`` of all .shp files under a glob, one task or more per file.

    A file that cannot be parsed gives one row with null rings, so that it can be reported.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    rows = [(name, n, [[{"x": x, "y": y} for x, y in part] for part in parts]) for n, parts in parse_shapes(content)]
                except (struct.error, ValueError):
                    rows = [(name, -1, None)]
                yield pd.DataFrame(rows, columns=["path", "record", "rings"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, record int, rings array<array<struct<x:double,y:double>>>")


def parse_attributes(data: bytes) -> list[dict[str, str | None]]:
    """The records of a .dbf file as text, in order; null for blanks."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        record, at, row = data[head + i * size : head + (i + 1) * size], 1, {}
        for name, width in fields:
            text = record[at : at + width].strip(b" \0")
            row[name] = text.decode("utf-8", errors="replace") if text else None
            at += width
        out.append(row)
    return out


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, record, fields map<string, string>)`` of all .dbf files under a glob; ``path`` has the shapes' ending."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows = [(name[:-3] + "shp", i + 1, list(r.items())) for i, r in enumerate(parse_attributes(content))]
                yield pd.DataFrame(rows, columns=["path", "record", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, record int, fields array<struct<k:string,v:string>>")
    return rows.withColumn("fields", F.map_from_entries("fields"))


def with_heights(shapes: DataFrame) -> DataFrame:
    """``shapes(.., fields)`` with ``height``: the first known column that any file has, 0 without one."""
    names = [r[0] for r in shapes.select(F.explode(F.map_keys("fields"))).distinct().collect()]  # columns of the files
    name = first_column(names, HEIGHT_COLUMNS)
    return heights(shapes if name is None else shapes.withColumn(name, F.try_element_at("fields", F.lit(name))))


def heights(buildings: DataFrame) -> DataFrame:
    """``height`` in metres from the first known column: storeys times 3, bad and non-positive values the median, at most twice the 99th percentile."""
    name = first_column(buildings.columns, HEIGHT_COLUMNS)
    if name is None:
        return buildings.withColumn("height", F.lit(0.0))
    scale = STOREY if any(part in name.lower() for part in LEVELS) else 1.0
    raw = F.col(f"`{name}`").cast("string").try_cast("double") * scale
    d = buildings.withColumn("__kerb_h", F.when(raw > 0, raw))
    middle = quantiles(d, "__kerb_h", [0.5]).select(F.coalesce(F.get("q", 0), F.lit(0.0)).alias("__kerb_m"))
    d = d.crossJoin(F.broadcast(middle)).withColumn("__kerb_h", F.coalesce("__kerb_h", "__kerb_m"))
    d = d.crossJoin(F.broadcast(quantiles(d, "__kerb_h", [0.99]).select(F.get("q", 0).alias("__kerb_t"))))
    return d.withColumn("height", F.least("__kerb_h", 2 * F.col("__kerb_t"))).drop("__kerb_h", "__kerb_m", "__kerb_t")
