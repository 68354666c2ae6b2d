"""Data-quality rules: one aggregate pass a table, fatal rules raise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``bad`` marks a failing row; more than ``allow`` of them (a share of rows) breaks the rule."""

    name: str
    bad: Column
    fatal: bool = False
    allow: float = 0.0


class ValidationError(ValueError):
    pass


def unique(name: str, keys: Sequence[str], df: DataFrame, fatal: bool = True) -> DataFrame:
    """Report row of a uniqueness rule: number of key groups with more than one row."""
    g = df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n_bad"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"))
    return g.select(F.lit(name).alias("rule"), F.lit(fatal).alias("fatal"), F.col("n_rows").cast("long"), F.col("n_bad").cast("long"), (F.col("n_bad") == 0).alias("passed"))


def report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, fatal, n_rows, n_bad, passed: all row rules in one scan."""
    sums = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(r.bad, F.lit(True))).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.fatal).alias("fatal"), F.col("n_rows"), F.col(f"r{i}").alias("n_bad"), (F.col(f"r{i}") <= r.allow * F.col("n_rows")).alias("passed")) for i, r in enumerate(rules)]
    return sums.select(F.inline(F.array(*rows)))


def references(name: str, df: DataFrame, key: str, parent: DataFrame, parent_key: str, fatal: bool = True) -> DataFrame:
    """Report row of a foreign-key rule."""
    orphans = df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").agg(F.count("*").alias("n_bad"))
    n = df.agg(F.count("*").alias("n_rows"))
    return n.join(orphans, F.lit(True)).select(F.lit(name).alias("rule"), F.lit(fatal).alias("fatal"), "n_rows", "n_bad", (F.col("n_bad") == 0).alias("passed"))


def enforce(result: DataFrame) -> DataFrame:
    """The report, or an error that names the fatal rules that failed."""
    broken = [r["rule"] for r in result.where("fatal and not passed").select("rule").collect()]
    if broken:
        raise ValidationError(f"failed: {', '.join(broken)}")
    return result


def shard_grid(parts: DataFrame, shard: str, key: str, expected: int) -> DataFrame:
    """Checks of a sharded run: missing shards, keys in two shards, repeated keys."""
    want = parts.sparkSession.range(expected).select(F.col("id").cast("int").alias(shard))
    missing = want.join(parts.select(shard).distinct(), shard, "left_anti").agg(F.count("*").alias("missing_shards"))
    keys = parts.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(shard).alias("s")).agg(F.count_if(F.col("s") > 1).alias("keys_in_two_shards"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
    return missing.join(keys, F.lit(True))


def run_gates(df: DataFrame, label: str, trace: str, floor: int = 1000, top_share: float = 0.98, trace_share: float = 0.95) -> DataFrame:
    """Gates of a judgment run: enough rows, no label that is nearly all, traces nearly everywhere."""
    c = df.groupBy(label).agg(F.count("*").alias("c"), F.count_if(F.length(F.trim(trace)) > 0).alias("t"))
    return c.agg(F.sum("c").alias("n_rows"), (F.max("c") / F.sum("c")).alias("top_share"), (F.sum("t") / F.sum("c")).alias("trace_share")).withColumn("ok", (F.col("n_rows") >= floor) & (F.col("top_share") <= top_share) & (F.col("trace_share") >= trace_share))


def group_size_profile(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.count("*").alias("n_groups"), F.median("count").alias("p50"), F.percentile("count", F.lit(0.95)).alias("p95"), F.max("count").alias("max"), F.avg("count").alias("mean"))
