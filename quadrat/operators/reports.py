"""Report aggregates: rates by code and gap, bands, arms of a probe, profiles, zone pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.functions import stats
from quadrat.operators.models import quantile_bands
from quadrat.operators.rows import first_per


def rate_by(df: DataFrame, by: Sequence[str], hit: Column, empty: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """n, hits, rate and Wilson interval of a boolean for each group."""
    g = df.where(hit.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    lo, hi = stats.wilson(F.col("hits"), F.col("n"), empty=empty)
    return g.select(*by, "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), lo.alias("low"), hi.alias("high"))


def rate_by_gap(df: DataFrame, gap: str, flag: str, hit: Column, bands: int = 4) -> DataFrame:
    """Rates by quantile band of a gap, one column a value of the flag."""
    b = quantile_bands(df.where(F.col(gap).isNotNull()), gap, bands)
    return b.where(hit.isNotNull()).groupBy("band").agg(*[F.avg(F.when(F.col(flag) == v, hit.cast("double"))).alias(f"rate_{str(v).lower()}") for v in (True, False)], *[F.count_if(F.col(flag) == v).alias(f"n_{str(v).lower()}") for v in (True, False)])


def pooled_contrast(bands: DataFrame) -> DataFrame:
    """Difference of the two rates pooled over bands, weighted by the smaller side."""
    w = F.least("n_true", "n_false")
    d = F.col("rate_true") - F.col("rate_false")
    return bands.where(d.isNotNull()).agg(F.try_divide(F.sum(d * w), F.sum(w)).alias("contrast"), F.sum(w).cast("long").alias("weight"))


def model_means(df: DataFrame, item: str, model: str, value: str, models: Sequence[str]) -> DataFrame:
    """Mean of each model for each item, with the row's mean and least over models and the rank by mean."""
    p = df.groupBy(item).pivot(model, list(models)).agg(F.avg(value))
    cols = [F.col(f"`{m}`") for m in models]
    have = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    out = p.withColumn("mean", F.try_divide(total, have)).withColumn("least", F.least(*cols) if len(cols) > 1 else cols[0])
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("mean"), item)))


def slices(ranked: DataFrame, rank: str, k: int) -> DataFrame:
    """Top, middle and bottom ``k`` rows of a ranked table of items."""
    n = ranked.agg(F.max(rank).alias("_n"))
    mid = (F.floor((F.col("_n") - k) / 2)).cast("int")
    r = F.col(rank)
    band = F.when(r <= k, "top").when(r > F.col("_n") - k, "bottom").when((r > mid) & (r <= mid + k), "middle")
    return ranked.join(F.broadcast(n), F.lit(True)).withColumn("slice", band).where(F.col("slice").isNotNull()).drop("_n")


def probe_arms(df: DataFrame, arm: str, abstained: Column) -> DataFrame:
    """Abstention rate of every arm with its interval, and z and p against the rest."""
    g = df.groupBy(arm).agg(F.count("*").alias("n"), F.count_if(abstained).alias("k"))
    total = g.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    j = g.join(F.broadcast(total), F.lit(True))
    z = stats.two_proportion_z(F.col("k").cast("double"), F.col("n").cast("double"), (F.col("_k") - F.col("k")).cast("double"), (F.col("_n") - F.col("n")).cast("double"))
    return j.select(arm, "n", "k", (F.col("k") / F.col("n")).alias("rate"), lo.alias("low"), hi.alias("high"), z.alias("z"), stats.normal_two_sided(z).alias("p"))


def newest_wide(df: DataFrame, key: str, year: str, metric: str, value: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of the newest year as columns."""
    newest = df.agg(F.max(year).alias("_y"))
    rows = df.join(F.broadcast(newest), F.col(year) == F.col("_y")).where(F.col(metric).isin(list(metrics)))
    return rows.groupBy(key).pivot(metric, list(metrics)).agg(F.avg(value))


def flattened(df: DataFrame, by: Sequence[str], items: str) -> DataFrame:
    """All list items of a group, sorted and distinct, without blanks."""
    x = df.select(*by, F.explode(items).alias("_i")).where(F.length(F.trim("_i")) > 0)
    return x.groupBy(*by).agg(F.array_sort(F.collect_set("_i")).alias(items), F.count("*").alias("n_items"))


def profile(df: DataFrame, column: str, by: Sequence[str] = (), points: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """n, min, mean, max and exact interpolated percentiles."""
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"), *[F.percentile(column, F.lit(p)).alias(f"p{round(p * 100):02d}") for p in points])


def runtime_stats(df: DataFrame, by: Sequence[str], started: str, ended: str, devices: int = 1) -> DataFrame:
    """Rows, span in seconds, rows a second, and that a device."""
    span = (F.unix_micros(F.max(F.col(ended).cast("timestamp"))) - F.unix_micros(F.min(F.col(started).cast("timestamp")))) / 1e6
    g = df.groupBy(*by).agg(F.count("*").alias("n"), span.alias("seconds"), F.max(F.lit(devices)).alias("devices"))
    return g.withColumn("rows_per_s", F.try_divide(F.col("n"), F.col("seconds"))).withColumn("rows_per_s_device", F.try_divide(F.col("rows_per_s"), F.col("devices")))


def coverage(expected: DataFrame, got: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Share of expected keys that have rows, rows, rows a key, silent and repeated keys for each group."""
    per = got.groupBy(*by, key).agg(F.count("*").alias("_c"))
    j = expected.select(*by, key).distinct().join(per, [*by, key], "left")
    return j.groupBy(*by).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"), F.count_if(F.col("_c").isNull()).alias("n_silent"), F.count_if(F.col("_c") > 1).alias("n_repeated"), (F.coalesce(F.sum("_c"), F.lit(0)) / F.count("*")).alias("rows_per_key"))


def vocabulary_report(df: DataFrame, by: Sequence[str], value: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside a vocabulary: share, and the distinct ones as sorted text."""
    out = F.col(value).isNotNull() & ~F.col(value).isin(list(allowed))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(out).alias("n_outside"), F.array_join(F.array_sort(F.collect_set(F.when(out, F.col(value)))), ", ").alias("outside"))


def sided_zones(pairs: DataFrame, zones_of: DataFrame, unit: str, zone: str) -> DataFrame:
    """Zone of both sides of every pair; sides that differ count for the pair table."""
    z = zones_of.select(unit, zone)
    out = pairs
    for s in ("a", "b"):
        out = out.join(z.select(F.col(unit).alias(f"{unit}_{s}"), F.col(zone).alias(f"{zone}_{s}")), f"{unit}_{s}", "left")
    return out


def gap_table(judged: DataFrame, values: DataFrame, unit: str, value: str, score: str) -> DataFrame:
    """Proxy gap and direction of every decided pair whose sides have different values, and whether the verdict agrees."""
    out = judged
    for s in ("a", "b"):
        out = out.join(values.select(F.col(unit).alias(f"{unit}_{s}"), F.col(value).alias(f"_v{s}")), f"{unit}_{s}")
    gap = F.col("_va") - F.col("_vb")
    rows = out.withColumn("gap", F.abs(gap)).withColumn("agrees", F.signum(gap) == F.signum(score))
    return rows.where((gap != 0) & (F.col(score) != 0) & F.col("gap").isNotNull()).drop("_va", "_vb")


def examples(df: DataFrame, order: Column, key: str, k: int, seed: object) -> DataFrame:
    """Top and bottom ``k`` keys by a score, each with one row chosen by hash."""
    best = df.select(key, order.alias("_o")).groupBy(key).agg(F.max("_o").alias("_o"))
    top = best.orderBy(F.desc("_o"), key).limit(k).withColumn("end", F.lit("top"))
    low = best.orderBy(F.asc("_o"), key).limit(k).withColumn("end", F.lit("bottom"))
    rows = df.join(F.broadcast(top.unionByName(low).select(key, "end")), key)
    return first_per(rows, ["end", key], F.xxhash64(F.lit(str(seed)), *[F.col(c) for c in df.columns]))


def best_twice(df: DataFrame, outer: str, inner: str, score: str) -> DataFrame:
    """Best row of each inner key, then the best of those of each outer key."""
    return first_per(first_per(df, [inner], F.desc_nulls_last(score), F.col(outer)), [outer], F.desc_nulls_last(score), F.col(inner))


def candidates_in_range(df: DataFrame, by: str, least: int, most: int) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n").between(least, most))


def binned(df: DataFrame, column: str, width: float, labels: Mapping[int, str]) -> DataFrame:
    """Counts of left-closed bins, every label present."""
    dim = df.sparkSession.createDataFrame([(i, x) for i, x in labels.items()], "bin int, label string")
    c = df.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(c, "bin", "left").fillna(0, ["n"])
