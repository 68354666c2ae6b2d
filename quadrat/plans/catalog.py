"""The image catalog: faces, manifests and recordings joined to canonical rows, and the recording index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.geo import face_bearing, wkb_point
from quadrat.operators.rows import first_per, hit_join


def build_faces(images: DataFrame, manifests: DataFrame, recordings: DataFrame, build_year: int, smallest: int = 0) -> DataFrame:
    """One row a face: manifest and recording attached, coordinates and year by fallback, bearing, key and point."""
    m = manifests.select("dataset", "group", "recording_dir", F.col("manifest.imageId").alias("_mid"), F.try_element_at(F.split("manifest.label", ","), F.lit(2)).try_cast("double").alias("_mlat"), F.try_element_at(F.split("manifest.label", ","), F.lit(1)).try_cast("double").alias("_mlon"), "manifest_ok")
    base = images.join(m, ["dataset", "group", "recording_dir"], "left").withColumn("recording_id", F.coalesce("_mid", "recording_dir"))
    r = recordings.select(F.col("imageId").alias("recording_id"), F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"), "recordedAt", F.col("year").alias("_ry"), "recorderDirection")
    out = hit_join(base, r, ["recording_id"], "catalog_hit")
    out = out.withColumn("latitude", F.coalesce("_mlat", "_rlat")).withColumn("longitude", F.coalesce("_mlon", "_rlon")).withColumn("year", F.coalesce(F.col("_ry").cast("int"), F.year("recordedAt"), F.lit(build_year)))
    out = out.withColumn("bearing", face_bearing(F.col("face"), F.col("recorderDirection")).cast("float")).withColumn("sample_id", F.concat_ws("_", "recording_id", "face")).withColumn("geom_wkb", wkb_point(F.col("longitude"), F.col("latitude"))).withColumn("small_file", F.col("length") < smallest)
    return out.drop("_mid", "_mlat", "_mlon", "_rlat", "_rlon", "_ry")


def rejoin(faces: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recording attributes derived anew; coordinates that rows already carry stay."""
    kept = faces.drop("recordedAt", "recorderDirection", "catalog_hit")
    r = recordings.select(F.col("imageId").alias("recording_id"), F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"), "recordedAt", "recorderDirection")
    out = hit_join(kept, r, ["recording_id"], "catalog_hit")
    return out.withColumn("latitude", F.coalesce("latitude", "_rlat")).withColumn("longitude", F.coalesce("longitude", "_rlon")).drop("_rlat", "_rlon")


def recording_index(faces: DataFrame) -> DataFrame:
    """One row a recording: counts and means over its faces in its first dataset. One shuffle on the recording."""
    per = faces.groupBy("recording_id", "dataset").agg(F.any_value("group", True).alias("group"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.min("recordedAt").alias("recordedAt"), F.count("*").alias("n_faces"), F.sum(F.coalesce(F.col("has_depth"), F.lit(False)).cast("int")).alias("n_depth_faces"), F.sum("length").alias("bytes_total"))
    one = first_per(per, ["recording_id"], F.col("dataset"))
    return one.withColumn("has_depth", F.col("n_depth_faces") > 0).withColumn("year", F.year("recordedAt")).withColumn("month", F.month("recordedAt"))
