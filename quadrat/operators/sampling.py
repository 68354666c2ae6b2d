"""Samplers and splits whose draws are fixed by hashes, so they do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quadrat.functions.columns import hash_unit
from quadrat.sources.storage import ensure_checkpoint_dir


def hash_order(seed: object, *keys: str) -> list[Column]:
    return [F.xxhash64(F.lit(str(seed)), *[F.col(k) for k in keys]), *[F.col(k) for k in keys]]


def sample_n(df: DataFrame, n: int, seed: object, *keys: str) -> DataFrame:
    """``n`` rows in hash order: a top-k plan, no global sort."""
    return df.orderBy(*hash_order(seed, *keys)).limit(n)


def even_quotas(available: dict[object, int], k: int) -> dict[object, int]:
    """Rows of each stratum by water-filling: all give up to one common level, the highest at which they do not exceed ``k``.

    What is then left of ``k`` goes one each to the first strata by name that have more. Rows without a stratum are not drawn.
    """
    sizes = {g: n for g, n in available.items() if g is not None}
    left, level = min(k, sum(sizes.values())), 0
    for i, n in enumerate(sorted(sizes.values())):
        # the strata from here on are all at least n large
        step = min(n - level, left // (len(sizes) - i))
        level, left = level + step, left - step * (len(sizes) - i)
        if level < n:
            break
    more = set(sorted((g for g, n in sizes.items() if n > level), key=str)[:left])
    return {g: 0 if g is None else min(n, level) + (g in more) for g, n in available.items()}


def proportional_quotas(available: dict[object, int], k: int) -> dict[object, int]:
    """Largest remainders."""
    total = sum(available.values())
    if not total:
        return {}
    exact = {g: min(k, total) * n / total for g, n in available.items()}
    out = {g: int(x) for g, x in exact.items()}
    for g in sorted(exact, key=lambda g: (-(exact[g] - int(exact[g])), str(g)))[: min(k, total) - sum(out.values())]:
        out[g] += 1
    return out


def stratified(df: DataFrame, by: str, k: int, seed: object, key: str, proportional: bool = False) -> DataFrame:
    """``k`` rows over the values of ``by`` (few): quotas on the driver from one count a stratum, rows by hash rank."""
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    quotas = (proportional_quotas if proportional else even_quotas)(sizes, k)
    if not quotas:
        return df.limit(0)
    table = df.sparkSession.createDataFrame([(g, q) for g, q in quotas.items() if g is not None], T.StructType([*df.select(by).schema.fields, T.StructField("_q", T.IntegerType())]))
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy(*hash_order(seed, key))))
    return ranked.join(F.broadcast(table), by).where(F.col("_rn") <= F.col("_q")).drop("_rn", "_q")


def per_cell(df: DataFrame, cells: Sequence[str], n: int, seed: object, key: str) -> DataFrame:
    """At most ``n`` rows a cell, by hash rank."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*cells).orderBy(*hash_order(seed, key)))).where(F.col("_rn") <= n).drop("_rn")


def split_within(df: DataFrame, by: str, ratio: float, seed: object, key: str) -> DataFrame:
    """Adds split: train for the first share of each stratum in hash order; both sides get a row where there are two."""
    w = W.partitionBy(by)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(*hash_order(seed, key)))
    cut = F.greatest(F.lit(1), F.least(F.floor(n * ratio), n - 1))
    return df.withColumn("split", F.when((r <= cut) | (n == 1), "train").otherwise("test"))


def split_ratios(df: DataFrame, by: str, ratios: dict[str, float], seed: object, key: str) -> DataFrame:
    """Adds split by cumulative half-even rounded shares of each stratum."""
    w = W.partitionBy(by)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(*hash_order(seed, key)))
    out, acc = F.lit(None).cast("string"), 1.0
    for name, share in reversed(list(ratios.items())):
        out, acc = F.when(r <= F.bround(n * acc), name).otherwise(out), acc - share
    return df.withColumn("split", out)


def interleave(df: DataFrame, by: str, seed: object, key: str, out: str = "position") -> DataFrame:
    """Round-robin order over strata: (rank in stratum, stratum)."""
    r = F.row_number().over(W.partitionBy(by).orderBy(*hash_order(seed, key)))
    return df.withColumn("_r", r).withColumn(out, F.struct("_r", by)).orderBy("_r", by).drop("_r")


def stride_shards(df: DataFrame, group: str, seq: str, shards: int, out: str = "shard") -> DataFrame:
    """Shard by number of the group in order of first appearance; a group is never split.

    Groups are numbered over range partitions: ranks inside a partition plus the sizes of those before.
    """
    firsts = df.groupBy(group).agg(F.min(seq).alias("_first"))
    numbered = dense_number(firsts, ["_first", group], "_i")
    return df.join(numbered.select(group, "_i"), group).withColumn(out, F.pmod("_i", F.lit(shards)).cast("int")).drop("_i")


def dense_number(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Numbers rows from 0 in a total order without pulling all rows into one task."""
    return sums_before(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")


def sums_before(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each in a total order: sums inside range partitions and one offset a partition.

    The partitions are checkpointed: their bounds are drawn from a sample and neighbours merged by size, so that rows
    dealt anew for the offsets would lie in others than those of the sums.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    w = W.partitionBy("_p").orderBy(*order)
    inside = ranged.withColumn("_k", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # one row a partition
    sizes = ranged.groupBy("_p").agg(F.sum(value).alias("_n"))
    before = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_offset")
    return inside.join(F.broadcast(before), "_p").withColumn(out, F.col("_offset") + F.col("_k") - F.col(value)).drop("_p", "_k", "_offset")


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Interpolated quantiles of the non-null values; empty without any. Values are counted and numbered over range partitions."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    numbered = sums_before(counts, ["v"], "c", "first")
    n = counts.agg(F.sum("c")).first()[0]
    if not n:
        return []
    places = [s * (n - 1) for s in shares]
    need = sorted({int(p) for p in places} | {min(n - 1, int(p) + 1) for p in places})
    # two values a share
    at = F.array(*[F.lit(int(p)) for p in need])
    rows = numbered.select("v", F.explode(F.filter(at, lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("c")))).alias("p")).collect()
    value = {r["p"]: r["v"] for r in rows}
    return [value[int(p)] + (p - int(p)) * (value[min(n - 1, int(p) + 1)] - value[int(p)]) for p in places]


def weighted_one(df: DataFrame, by: Sequence[str], weight: str, seed: object, key: str) -> DataFrame:
    """One row a group, drawn in proportion to weight (uniformly where all weights are 0): least -ln(u) / w."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    total = F.sum(w).over(W.partitionBy(*by))
    use = F.when(total > 0, w).otherwise(1.0)
    draw = F.when(use > 0, -F.ln(hash_unit(seed, F.col(key)) + 1e-18) / use)
    rest = [c for c in df.columns if c not in by]
    return df.withColumn("_d", draw).groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("_d", key)).alias("_r")).select(*by, "_r.*")


def pair_of(number: Column) -> tuple[Column, Column]:
    """(low, high) of the pair with this number, where pairs are numbered by their high member, then the low."""
    high = F.floor((1 + F.sqrt(1 + 8 * number.cast("double"))) / 2).cast("long")
    whole = lambda h: F.shiftright(h * (h - 1), 1)
    # the root may be one off for large numbers
    high = F.when(whole(high) > number, high - 1).when(whole(high + 1) <= number, high + 1).otherwise(high)
    return number - whole(high), high


def distinct_pairs(ids: DataFrame, key: str, n: int, seed: object) -> DataFrame:
    """``n`` distinct unordered pairs (a, b), or all if there are fewer; the sides of a pair are flipped by a hash.

    Pairs have numbers; these are drawn by hash until ``n`` different ones are there (or all are listed, where
    ``n`` is half of them or more), then turned into ids. Work follows ``n`` and the ids, never their square.
    """
    spark = ids.sparkSession
    rows = dense_number(ids.select(key).distinct(), [key], "_i")
    m = rows.count()
    total = m * (m - 1) // 2
    if 2 * n >= total:
        numbers = spark.range(total).select(F.col("id").alias("p"))
    else:
        draws = int(1.6 * n) + 100
        draw = lambda k: spark.range(k).select(F.pmod(F.xxhash64(F.lit(str(seed)), "id"), F.lit(total)).alias("p")).distinct()
        while (numbers := draw(draws)).count() < n:
            draws *= 2
    top = numbers.orderBy(F.xxhash64(F.lit(str(seed)), "p"), "p").limit(n)
    low, high = pair_of(F.col("p"))
    flip = hash_unit(f"{seed}flip", F.col("p")) < 0.5
    named = top.select("p", low.alias("x"), high.alias("y")).join(rows.select(F.col("_i").alias("x"), F.col(key).alias("_a")), "x").join(rows.select(F.col("_i").alias("y"), F.col(key).alias("_b")), "y")
    return named.select(F.when(flip, F.col("_b")).otherwise(F.col("_a")).alias("a"), F.when(flip, F.col("_a")).otherwise(F.col("_b")).alias("b"))


def perfect_matching(ids: DataFrame, key: str, seed: object) -> DataFrame:
    """Disjoint pairs: neighbours in hash order; an odd one out is left."""
    numbered = dense_number(ids.select(key).distinct().withColumn("_h", F.xxhash64(F.lit(str(seed)), key)), ["_h", key], "_i")
    half = numbered.withColumn("_j", F.floor(F.col("_i") / 2))
    return half.groupBy("_j").agg(F.min_by(key, "_i").alias("a"), F.max_by(key, "_i").alias("b"), F.count("*").alias("_n")).where("_n = 2").select("a", "b")


def pair_table(pairs: DataFrame, repeats: int = 1, counterbalance: str = "balanced", seed: object = 0) -> DataFrame:
    """Presented pairs: canonical_pair_id, repeat_idx, pair_id, is_swapped, presented_order for pairs (a, b).

    counterbalance: none (never swapped), random (by hash), balanced (odd repeats are swapped).
    """
    canonical = F.concat_ws("__", F.least(F.col("a").cast("string"), F.col("b").cast("string")), F.greatest(F.col("a").cast("string"), F.col("b").cast("string")))
    rows = pairs.select("a", "b", canonical.alias("canonical_pair_id"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_idx"))
    if counterbalance == "none":
        swapped = F.lit(False)
    elif counterbalance == "random":
        swapped = hash_unit(seed, F.col("canonical_pair_id"), F.col("repeat_idx")) < 0.5
    elif counterbalance == "balanced":
        swapped = F.pmod("repeat_idx", F.lit(2)) == 1
    else:
        raise ValueError(f"unknown counterbalance {counterbalance!r}")
    return rows.withColumn("is_swapped", swapped).withColumn("presented_order", F.when(F.col("is_swapped"), "B_then_A").otherwise("A_then_B")).withColumn("pair_id", F.concat_ws("__r", "canonical_pair_id", F.col("repeat_idx").cast("string")))


def unit_pairs(images: DataFrame, unit: str, image: str, weight: str, n: int, seed: object) -> DataFrame:
    """Distinct unit pairs, then one weighted image a side: unit_a, unit_b, image_a, image_b.

    A unit's images lie one behind the other on a line as long as its weights (uniform where all are 0); a pair's side draws a
    place on it and takes the image there, so a unit's images are read once, not once a pair.
    """
    have = images.where(F.col(unit).isNotNull()).select(F.col(unit).alias("_u"), F.col(image).alias("_img"), F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_w"))
    sums = have.groupBy("_u").agg(F.sum("_w").alias("_s"), F.count("*").alias("_n")).select("_u", (F.col("_s") > 0).alias("_weighted"), F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.col("_n").cast("double")).alias("_len"))
    line = have.join(sums, "_u").withColumn("_w", F.when(F.col("_weighted"), F.col("_w")).otherwise(1.0)).where("_w > 0")
    start = F.sum("_w").over(W.partitionBy("_u").orderBy("_img").rowsBetween(W.unboundedPreceding, -1))
    starts = line.select("_u", F.coalesce(start, F.lit(0.0)).alias("_at"), "_img", F.lit(None).cast("string").alias("_pair"))
    out = distinct_pairs(have.select(F.col("_u").alias(unit)).distinct(), unit, n, seed).withColumn("_pair", F.concat_ws("__", F.col("a").cast("string"), F.col("b").cast("string")))
    picked = out
    for side in ("a", "b"):
        place = hash_unit(f"{seed}{side}", F.col("_pair")) * F.col("_len")
        draws = out.select(F.col(side).alias("_u"), "_pair").join(sums, "_u").select("_u", place.alias("_at"), F.lit(None).cast(have.schema["_img"].dataType).alias("_img"), "_pair")
        # at one place the image that begins there comes first
        order = W.partitionBy("_u").orderBy("_at", F.col("_pair").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
        hit = starts.unionByName(draws).withColumn("_hit", F.last("_img", ignorenulls=True).over(order)).where("_pair is not null")
        picked = picked.join(hit.select("_pair", F.col("_hit").alias(f"image_{side}")), "_pair")
    return picked.select(F.col("a").alias("unit_a"), F.col("b").alias("unit_b"), "image_a", "image_b")


def grid_seeds(nodes: DataFrame, key: str, row: Column, col: Column, k: int, seed: object) -> DataFrame:
    """``k`` nodes spread over grid cells in proportion to their nodes."""
    celled = nodes.withColumn("_cell", F.concat_ws(":", row.cast("string"), col.cast("string")))
    total = F.count("*").over(W.partitionBy("_cell"))
    spread = (F.row_number().over(W.partitionBy("_cell").orderBy(*hash_order(seed, key))) - 0.5) / total
    return celled.withColumn("_s", spread).orderBy("_s", *hash_order(seed, key)).limit(k).drop("_cell", "_s")
