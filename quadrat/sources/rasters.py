"""Grids of cells as GeoTIFF bands, and images of any folder depth as tables."""

from __future__ import annotations

import struct
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of TIFF fields and their sizes: fixed by the format.
ASCII, SHORT, LONG, DOUBLE = 2, 3, 4, 12
SIZES = {ASCII: 1, SHORT: 2, LONG: 4, DOUBLE: 8}
CODES = {ASCII: "s", SHORT: "H", LONG: "I", DOUBLE: "d"}


def grid_array(cells: DataFrame, value: str = "value", most_cells: int = 1 << 26) -> tuple[np.ndarray, int, int]:
    """(rows by columns, north first, missing cells NaN; the largest row; the smallest column) of (row, col, value).

    The grid must have ``most_cells`` cells at most, since it is put together on the driver.
    """
    b = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if b["r0"] is None:
        return np.full((0, 0), np.nan, np.float32), 0, 0
    h, w = b["r1"] - b["r0"] + 1, b["c1"] - b["c0"] + 1
    if h * w > most_cells:
        raise ValueError(f"a grid of {h} x {w} cells; write it in tiles")
    out = np.full((h, w), np.nan, np.float32)
    got = cells.select("row", "col", F.col(value).cast("double").alias("v")).where("v is not null").toArrow()
    out[b["r1"] - got["row"].to_numpy(), got["col"].to_numpy() - b["c0"]] = got["v"].to_numpy()
    return out, b["r1"], b["c0"]


def geotiff(grid: np.ndarray, left: float, top: float, cell: float, epsg: int, text: str = "") -> bytes:
    """One uncompressed little-endian float band with its place: pixel scale, tie point and projection key; ``text`` is the description."""
    h, w = grid.shape
    data = np.ascontiguousarray(grid, "<f4").tobytes()
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]
    fields = [
        (256, LONG, [w]), (257, LONG, [h]), (258, SHORT, [32]), (259, SHORT, [1]), (262, SHORT, [1]), (270, ASCII, text.encode() + b"\0"), (273, LONG, [0]), (277, SHORT, [1]), (278, LONG, [h]), (279, LONG, [len(data)]),
        (339, SHORT, [3]), (33550, DOUBLE, [cell, cell, 0.0]), (33922, DOUBLE, [0.0, 0.0, 0.0, left, top, 0.0]), (34735, SHORT, keys), (42113, ASCII, b"nan\0"),
    ]
    at = 8 + 2 + 12 * len(fields) + 4
    tail, entries = b"", []
    sizes = [len(v) * SIZES[kind] for _, kind, v in fields]
    start = at + sum(n + n % 2 for n in sizes if n > 4)
    for (tag, kind, values), n in zip(fields, sizes):
        if tag == 273:
            values = [start]
        raw = bytes(values) if kind == ASCII else struct.pack(f"<{len(values)}{CODES[kind]}", *values)
        if n <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place, tail = struct.pack("<I", at + len(tail)), tail + raw + b"\0" * (n % 2)
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + place)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + b"".join(entries) + struct.pack("<I", 0) + tail + data


def write_band(cells: DataFrame, path: str, cell: float, epsg: int, value: str = "value", tags: Mapping[str, object] | None = None) -> None:
    """A (row, col, value) grid as a GeoTIFF on any file system that Spark knows."""
    import json

    spark = cells.sparkSession
    grid, row, col = grid_array(cells, value)
    data = geotiff(grid, col * cell, (row + 1) * cell, cell, epsg, json.dumps(tags or {}, sort_keys=True, default=str))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()


def image_table(spark: SparkSession, root: str, glob: str = "*.jpg") -> DataFrame:
    """Images below ``root`` at whatever depth: path, length, name, extension, depth and folders (from the root down)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    parts = F.split(F.substring_index("path", base + "/", -1), "/")
    name = F.element_at(parts, -1)
    return files.select("path", "length", F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), F.lower(F.substring_index(name, ".", -1)).alias("extension"), (F.size(parts) - 1).alias("depth"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"))
