"""Writers: partitioned tables, staged rewrites, parts with resume, GeoJSON, shards."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.sampling import dense_number, hash_order


def write_partitioned(df: DataFrame, root: str, by: Sequence[str] = ("dataset", "year")) -> None:
    """Overwrites the partitions that the rows belong to and no others; rows are dealt by partition first, so files are few; AQE splits large ones."""
    df.hint("rebalance", *by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(root)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Derived table, made only if absent."""
    df.write.option("compression", "zstd").mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def rewrite(spark: SparkSession, root: str, change, staging: str, by: Sequence[str] = ("dataset", "year")) -> None:
    """Change a table in place by way of a staging folder, since a plan cannot overwrite what it reads."""
    change(spark.read.parquet(root)).write.mode("overwrite").partitionBy(*by).parquet(staging)
    write_partitioned(spark.read.parquet(staging), root, by)


def plain(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Nested columns as JSON text, unwanted ones dropped."""
    kept = [c for c in df.columns if c not in drop]
    nested = ("struct", "map", "array")
    kinds = dict(df.dtypes)
    return df.select(*[F.to_json(c).alias(c) if kinds[c].startswith(nested) else F.col(c) for c in kept])


def write_geojson(df: DataFrame, path: str, x: str, y: str, properties: Sequence[str]) -> None:
    """One point feature a line."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def sharded(df: DataFrame, size: int, seed: object, key: str, out: str = "shard") -> DataFrame:
    """Shards of ``size`` rows in hash order."""
    h = df.withColumn("_h", hash_order(seed, key)[0])
    return dense_number(h, ["_h", key], "_i").withColumn(out, F.floor(F.col("_i") / size).cast("int")).drop("_i", "_h")


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    df.repartition(shard).sortWithinPartitions(shard).write.mode("overwrite").partitionBy(shard).parquet(path)


def missing_work(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not yet done: the resume step of a chunked job."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def fingerprint(settings: Mapping) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def guarded_read(spark: SparkSession, path: str, settings: Mapping, column: str = "_fingerprint") -> DataFrame:
    """A prebuilt table, refused if it was built with other settings."""
    df = spark.read.parquet(path)
    row = df.select(column).limit(1).collect()
    if not row or row[0][0] != fingerprint(settings):
        raise ValueError(f"{path} was built with other settings")
    return df.drop(column)


def task_json(df: DataFrame, data: Sequence[str], out: str = "task") -> DataFrame:
    """Annotation tasks: {"data": {...}}."""
    return df.select(F.to_json(F.struct(F.struct(*data).alias("data"))).alias(out))


def write_json(spark: SparkSession, path: str, value: Mapping) -> None:
    """Small JSON file, replaced in one rename, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, default=str).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(temp, target):
        raise OSError(f"cannot rename to {path}")


def preview(df: DataFrame, key: str, first: Sequence[str], heavy: Sequence[str] = (), n: int = 1000, seed: object = 0) -> DataFrame:
    """At most ``n`` rows by hash, without heavy columns, chosen columns first."""
    kept = [c for c in df.columns if c not in heavy]
    return df.select(*[c for c in first if c in kept], *[c for c in kept if c not in first]).orderBy(*hash_order(seed, key)).limit(n)


def copy_files(df: DataFrame, source: str, target: str, copy) -> DataFrame:
    """``copy(source, target)`` for every row in the tasks; returns the rows with status ok, missing or the error."""
    from collections.abc import Iterator

    import pandas as pd

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            said = []
            for a, b in zip(pdf[source], pdf[target]):
                try:
                    copy(a, b)
                    said.append("ok")
                except FileNotFoundError:
                    said.append("missing")
                except OSError as e:
                    said.append(f"error: {e}"[:200])
            yield pdf.assign(status=said)

    rows = df.select(source, target)
    return rows.mapInPandas(work, f"{source} string, {target} string, status string")
