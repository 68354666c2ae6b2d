"""Tiles, boxes and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiles(df: DataFrame, width: str, height: str, size: int, overlap: int = 0) -> DataFrame:
    """One row a tile: tile, left, top, tile_w, tile_h; the last of a row or column is moved inside the image."""
    step = max(1, size - overlap)

    def starts(n: Column) -> Column:
        last = F.greatest(F.lit(0), n - size)
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last + F.when(last % step == 0, 0).otherwise(step), F.lit(step)), lambda s: F.least(s, last)))

    out = df.withColumn("top", F.explode(starts(F.col(height)))).withColumn("left", F.explode(starts(F.col(width))))
    return out.withColumn("tile_w", F.least(F.lit(size), F.col(width))).withColumn("tile_h", F.least(F.lit(size), F.col(height)))


def upper_part(box: Column, share: float, narrow: float = 0.0) -> Column:
    """Top share of a box struct(x0, y0, x1, y1), narrowed on both sides: a face from a person."""
    w = box["x1"] - box["x0"]
    return F.struct((box["x0"] + w * narrow).alias("x0"), box["y0"].alias("y0"), (box["x1"] - w * narrow).alias("x1"), (box["y0"] + (box["y1"] - box["y0"]) * share).alias("y1"))


def lower_part(box: Column, share: float, narrow: float = 0.0) -> Column:
    """Bottom share of a box: a plate from a vehicle."""
    w = box["x1"] - box["x0"]
    return F.struct((box["x0"] + w * narrow).alias("x0"), (box["y1"] - (box["y1"] - box["y0"]) * share).alias("y0"), (box["x1"] - w * narrow).alias("x1"), box["y1"].alias("y1"))


def points_box(points: Column, least: float) -> Column:
    """Box around the key points seen with confidence; null if none is. Points are struct(x, y, c)."""
    seen = F.filter(points, lambda p: p["c"] >= least)
    x, y = F.transform(seen, lambda p: p["x"]), F.transform(seen, lambda p: p["y"])
    return F.when(F.size(seen) > 0, F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")))


def centre_in(box: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a box's centre lies in a fixed region."""
    return ((box["x0"] + box["x1"]) / 2).between(x0, x1) & ((box["y0"] + box["y1"]) / 2).between(y0, y1)


def detections(df: DataFrame, source: str, keys: list[str], fields: str, sentinel: str) -> DataFrame:
    """One row a detection of a JSON list; images without any keep one row whose ``label`` is the sentinel."""
    parsed = F.from_json(F.col(source), f"array<struct<{fields}>>")
    rows = df.select(*keys, F.explode_outer(parsed).alias("_d"))
    return rows.select(*keys, "_d.*").withColumn("label", F.coalesce("label", F.lit(sentinel)))


def yaw_degrees(df: DataFrame, yaw: str) -> DataFrame:
    """Yaw in degrees; a column whose median size is below 2 pi is taken for radians."""
    m = df.agg((F.median(F.abs(yaw)) < 6.2832).alias("_rad"))
    return df.join(F.broadcast(m), F.lit(True)).withColumn(yaw, F.pmod(F.when(F.col("_rad"), F.degrees(yaw)).otherwise(F.col(yaw)), F.lit(360.0))).drop("_rad")


def features_match(have: Column, wanted: str) -> Column:
    """Whether a set of features meets an expression of names with & and |; & binds tighter."""
    out = F.lit(False)
    for option in wanted.split("|"):
        both = F.lit(True)
        for name in option.split("&"):
            both = both & F.array_contains(have, name.strip())
        out = out | both
    return out if wanted.strip() else F.lit(True)
