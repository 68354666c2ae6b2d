"""Readers: partitioned catalogs, dirty CSV, image trees, JSON manifests, logs, GeoJSON, accounting text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.columns import parse_dates
from quadrat.operators.rows import first_per, typed


def scan_catalog(spark: SparkSession, root: str, datasets: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """Partitioned Parquet; the filters prune directories."""
    df = spark.read.parquet(root)
    if datasets is not None:
        df = df.where(F.col("dataset").isin(list(datasets)))
    return df if years is None else df.where(F.col("year").isin(list(years)))


def query_catalog(df: DataFrame, faces: Sequence[str] | None = None, first: str | None = None, last: str | None = None, ts: str = "recordedAt", within: Column | None = None, where: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Conjunctive query; bounds are inclusive and a bare end date means its midnight."""
    if faces:
        df = df.where(F.col("face").isin(list(faces)))
    if first:
        df = df.where(F.col(ts) >= F.lit(first).cast(df.schema[ts].dataType))
    if last:
        df = df.where(F.col(ts) <= F.lit(last).cast(df.schema[ts].dataType))
    if within is not None:
        df = df.where(within)
    if where is not None:
        df = df.where(where if where.strip() else "false")
    return df.select(*columns) if columns else df


def in_box(df: DataFrame, lat: str, lon: str, a: tuple[float, float], b: tuple[float, float], most: int | None = None, seed: object = 0, key: str | None = None) -> DataFrame:
    """Rows in the box of two corners in any order; beyond ``most`` rows a uniform sample by hash."""
    lo, hi = [min(x) for x in zip(a, b)], [max(x) for x in zip(a, b)]
    out = df.where(F.col(lat).between(lo[0], hi[0]) & F.col(lon).between(lo[1], hi[1]))
    return out if most is None else out.orderBy(F.xxhash64(F.lit(str(seed)), key or lat)).limit(most)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None, where: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Parquet file or folder of parts: filter, projection and rename are pushed to the scan; required columns are checked."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    if where:
        df = df.where(where)
    if columns:
        df = df.select(*[c for c in columns if c in df.columns])
    return df.withColumnsRenamed({a: b for a, b in (rename or {}).items() if a in df.columns})


def read_csv_strings(spark: SparkSession, paths: Sequence[str], delimiter: str = ",") -> DataFrame:
    """All columns as text, files with different columns united by name, the file kept as _file."""
    frames = [spark.read.csv(p, header=True, inferSchema=False, sep=delimiter).withColumn("_file", F.col("_metadata.file_path")) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_recordings_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, key: str = "imageId", time: str = "recordedAt", zone: str = "America/New_York") -> DataFrame:
    """Recording CSVs: first row a key by file order, lenient casts, times as local timestamps."""
    raw = read_csv_strings(spark, paths)
    one = first_per(raw, [key], F.col("_file"), *[F.col(c) for c in raw.columns if c not in (key, "_file")])
    t = F.try_to_timestamp(F.regexp_replace(time, r"(\.\d{6})\d+", "$1"))
    return typed(one.withColumn(time, F.from_utc_timestamp(F.to_utc_timestamp(t, "UTC"), zone)), schema)


IMAGE_PATH = r"([^/]+)/([^/]+)/([^/]+)/faces/([FBLRUD])\.(?:jpg|jpeg|png)$"


def list_images(spark: SparkSession, roots: Sequence[str], pattern: str = IMAGE_PATH, parts: Sequence[str] = ("dataset", "group", "recording_dir", "face"), glob: str = "*.jpg") -> DataFrame:
    """Image files with size and time; path parts by pattern, others left out. Contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(list(roots))
    return df.select("path", "length", "modificationTime", *[F.regexp_extract("path", pattern, i + 1).alias(p) for i, p in enumerate(parts)]).where(F.col("path").rlike(pattern))


def read_manifests(spark: SparkSession, root: str, schema: T.StructType | str, name: str = "manifest.json") -> DataFrame:
    """One JSON file a recording: manifest (null if malformed), manifest_ok, group and recording_dir from the path."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    m = F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "PERMISSIVE"})
    ok = F.try_parse_json("value").isNotNull() if hasattr(F, "try_parse_json") else m.isNotNull()
    return df.select("path", F.element_at(F.split("path", "/"), -3).alias("group"), F.element_at(F.split("path", "/"), -2).alias("recording_dir"), F.when(ok, m).alias("manifest"), ok.alias("manifest_ok"))


def parse_label(c: Column) -> tuple[Column, Column]:
    """(lat, lon) of "lon,lat" text; null where it does not parse."""
    p = F.split(c, ",")
    return F.try_element_at(p, F.lit(2)).try_cast("double"), F.try_element_at(p, F.lit(1)).try_cast("double")


def read_registry(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines: (records, one row with the number of lines that do not parse)."""
    text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = text.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok").select("r.*"), parsed.agg(F.count_if(~F.col("ok")).alias("n_bad"))


def read_polygons(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """GeoJSON polygons: properties and ring, an array of struct(x, y); multipolygons give a row a part."""
    text = spark.read.option("wholetext", "true").text(path)
    f = text.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    kind, coords = F.get_json_object("f", "$.geometry.type"), F.get_json_object("f", "$.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(coords, "array<array<array<double>>>"))).otherwise(F.from_json(coords, "array<array<array<array<double>>>>"))
    ring = F.transform(F.get(F.col("_p"), 0), lambda q: F.struct(F.get(q, 0).alias("x"), F.get(q, 1).alias("y")))
    return f.select(*[F.get_json_object("f", f"$.properties.{p}").alias(p) for p in properties], F.explode(parts).alias("_p")).withColumn("ring", ring).drop("_p")


def read_census(spark: SparkSession, path: str, key: str, value: str, pattern: str = r"US(\d{11})$") -> DataFrame:
    """CSV whose second row is a caption: geoid by pattern, value leniently numeric."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(F.regexp_extract(key, pattern, 1).alias("geoid"), F.col(value).try_cast("double").alias("value")).where("geoid != ''")


def read_jobs(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Pipe-delimited accounting text; submit, start and end are parsed where present."""
    df = spark.read.csv(path, sep="|", header=False, inferSchema=False).toDF(*columns)
    return df.withColumns({c: parse_dates(F.col(c)) for c in ("submit", "start", "end") if c in columns})


def load_run(results: DataFrame, pairs: DataFrame, key: str, score: str, canonical: str = "canonical_pair_id") -> DataFrame:
    """Judgments with their pairs, one to one; unscored rows go; the pair is its own canonical id by default."""
    from quadrat.operators.rows import join_one_to_one

    extra = [c for c in pairs.columns if c == key or c not in results.columns]
    out = join_one_to_one(results, pairs.select(*extra), [key])
    out = out.withColumn(score, F.col(score).cast("string").try_cast("double")).where(F.col(score).isNotNull())
    return out if canonical in out.columns else out.withColumn(canonical, F.col(key))


def ordered_parts(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files in the order of the first row number in their names, the name on ties: _chunk added."""
    df = spark.read.parquet(path).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return df.withColumn("_chunk", F.struct(F.regexp_extract("_file", r"(\d+)", 1).try_cast("long").alias("first"), F.col("_file").alias("name"))).drop("_file")


def without_names(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Rows whose text holds none of the words, whatever the case."""
    return df if not words else df.where(~F.lower(F.col(column)).rlike("|".join(r"\Q" + w.lower() + r"\E" for w in words)))


def sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], **values) -> DataFrame:
    """User SQL over named tables with bound values."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=values or None)
