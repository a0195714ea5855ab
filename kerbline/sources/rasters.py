"""GeoTIFF rasters: files read through Spark into cell tables, and cell tables written as single-band files.

Baseline files are understood: strips or tiles, no compression or deflate, horizontal predictor, integers and floats of
either byte order. Files of a glob are tiles of one raster and become rows with their number, ready for a mosaic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -99999.0
#: Sizes of TIFF field types, and their struct codes (fixed values of the format).
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


@dataclass
class Band:
    """One raster band: values, affine (a, c, e, f) and the value that stands for no data."""

    values: np.ndarray
    affine: tuple[float, float, float, float]
    nodata: float
    degrees: bool = False


def _tags(data: bytes) -> tuple[dict[int, tuple], str]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        raise ValueError("no baseline TIFF")
    out = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        size = _SIZES[kind] * n
        where = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        raw = data[where : where + size]
        out[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{n}{_CODES[kind]}", raw) if kind in _CODES else (raw,)
    return out, order


def read_tiff(data: bytes) -> Band:
    """The first band of a file."""
    tags, order = _tags(data)
    width, height = tags[256][0], tags[257][0]
    bits, kind, samples = tags.get(258, (8,))[0], tags.get(339, (1,))[0], tags.get(277, (1,))[0]
    compression, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if compression not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor} is not supported")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
    tiled = 322 in tags
    wide, tall = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across = -(-width // wide)
    out = np.zeros((-(-height // tall) * tall, across * wide), dtype)
    for i in range(across * -(-height // tall)):
        raw = data[starts[i] : starts[i] + sizes[i]]
        part = np.frombuffer(raw if compression == 1 else zlib.decompress(raw), dtype)
        part = part[: len(part) // (wide * samples) * wide * samples].reshape(-1, wide, samples)[:, :, 0]
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=dtype)
        r, c = divmod(i, across)
        out[r * tall : r * tall + len(part), c * wide : (c + 1) * wide] = part
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    affine = (scale[0], tie[3] - tie[0] * scale[0], -scale[1], tie[4] + tie[1] * scale[1])
    keys = tags.get(34735, ())
    degrees = any(keys[i] == 1024 and keys[i + 3] == 2 for i in range(4, len(keys) - 3, 4))  # the model is geographic
    return Band(out[:height, :width], affine, float(tags[42113][0]) if 42113 in tags else NODATA, degrees)


def write_tiff(band: Band) -> bytes:
    """A single-strip file without compression; doubles."""
    a, c, e, f = band.affine
    body = np.ascontiguousarray(band.values, "<f8").tobytes()
    height, width = band.values.shape
    text = repr(float(band.nodata)).encode() + b"\0"
    text += b"\0" * (8 - len(text) % 8)
    model = [(34735, 3, (1, 1, 0, 1, 1024, 0, 1, 2 if band.degrees else 1))]
    entries = [
        (256, 4, (width,)), (257, 4, (height,)), (258, 3, (64,)), (259, 3, (1,)), (262, 3, (1,)), (273, 4, (8,)), (277, 3, (1,)), (278, 4, (height,)),
        (279, 4, (len(body),)), (339, 3, (3,)), (33550, 12, (a, -e, 0.0)), (33922, 12, (0.0, 0.0, 0.0, c, f, 0.0)), *model, (42113, 2, text),
    ]
    at = 8 + len(body)
    extra_at = at + 2 + 12 * len(entries) + 4
    head, extra = struct.pack("<H", len(entries)), b""
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
        inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", extra_at + len(extra))
        extra += raw if len(raw) > 4 else b""
        head += struct.pack("<HHI", tag, kind, len(values)) + inline
    return b"II" + struct.pack("<HI", 42, at) + body + head + struct.pack("<I", 0) + extra


def read_meta(spark: SparkSession, path: str) -> list[tuple[str, tuple[float, float, float, float], int, int, float, bool]]:
    """``(file, affine, height, width, nodata, degrees)`` of each file, in order of name; an empty glob is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                band = read_tiff(content)
                rows.append((name, list(band.affine), *band.values.shape, band.nodata, band.degrees))
            yield pd.DataFrame(rows, columns=["path", "affine", "height", "width", "nodata", "degrees"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(run, "path string, affine array<double>, height int, width int, nodata double, degrees boolean").orderBy("path").collect()
    if not found:
        raise FileNotFoundError(path)
    return [(r.path, tuple(r.affine), r.height, r.width, r.nodata, r.degrees) for r in found]


def read_cells(spark: SparkSession, path: str, block: int = 256) -> DataFrame:
    """``(path, row, col, value)`` of all files of a glob, no data as null; rows leave the workers in blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                band = read_tiff(content)
                for top in range(0, len(band.values), block):
                    part = band.values[top : top + block].astype(float)
                    rows, cols = np.indices(part.shape)
                    v = pd.Series(part.ravel())
                    yield pd.DataFrame({"path": name, "row": (rows.ravel() + top).astype("int32"), "col": cols.ravel().astype("int32"), "value": v.where((v != band.nodata) & np.isfinite(v))})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(run, "path string, row int, col int, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def to_band(cells: DataFrame, affine: tuple[float, float, float, float], height: int, width: int, nodata: float = NODATA) -> Band:
    """A small raster on the driver, for :func:`write_tiff`; larger ones stay cell tables."""
    table = cells.select("row", "col", F.col("value").cast("double").alias("value")).toArrow()
    values = np.full((height, width), nodata)
    v = table.column("value").to_numpy()
    values[table.column("row").to_numpy(), table.column("col").to_numpy()] = np.where(np.isnan(v), nodata, v)
    return Band(values, affine, nodata)
