"""Streams give the same tables as batches; the stateful operator closes sessions by its rules."""

import pytest
from pyspark.sql import functions as F

from quadrat.streaming import events


@pytest.fixture()
def source(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 5).alias("user"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 37 + F.when(F.col("id") % 50 == 0, 3000).otherwise(0)).alias("ts"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("id").cast("double").alias("v"))
    path = str(tmp_path / "in")
    rows.repartition(3).write.parquet(path)
    return path, spark.read.parquet(path)


def settle(q):
    q.awaitTermination(120)
    assert q.exception() is None


def test_windows_match_batch(spark, source):
    path, batch = source
    for k, f in enumerate((lambda d: events.tumbling(d, "ts", "10 minutes", ["user"], value="v"), lambda d: events.gap_sessions(d, "ts", "200 seconds", ["user"]))):
        settle(events.to_memory(f(events.read_events(spark, path, batch.schema)), f"w{k}"))
        assert sorted(map(tuple, spark.table(f"w{k}").collect())) == sorted(map(tuple, f(batch).collect()))


def test_rule_sessions(spark, tmp_path):
    t0 = 1_700_000_000
    data = [("a", 0, 0.0), ("a", 10, 1.0), ("a", 20, 500.0), ("a", 400, 500.0), ("z", 100000, 0.0)]
    rows = spark.createDataFrame(data, "k string, s int, x double").select("k", F.timestamp_seconds(t0 + F.col("s")).alias("ts"), "x", F.lit(0.0).alias("y"))
    rows.where("k = 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("k = 'z'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), rows.schema, per_trigger=1)
    out = events.rule_sessions(stream, "k", "ts", "x", "y", 60, 100, "1 second")
    settle(events.to_memory(out, "rs", "append"))
    got = sorted((r["session"], r["n"]) for r in spark.table("rs").collect() if r["k"] == "a")
    assert got[:2] == [(0, 2), (1, 1)]


def test_parts_are_idempotent(spark, source, tmp_path):
    path, batch = source
    stream = events.read_events(spark, path, batch.schema)
    settle(events.to_parts(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["v"]))
    settle(events.to_parts(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["v"]))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
