"""Projection, deduplication, unions, joins with rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def typed(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Exactly the schema's columns in its order, leniently cast; absent ones are typed nulls."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = set(df.columns)

    def one(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        return (F.col(f.name).try_cast(f.dataType) if isinstance(f.dataType, T.AtomicType) else F.col(f.name).cast(f.dataType)).alias(f.name)

    return df.select(*[one(f) for f in want.fields])


def present_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def renamed(df: DataFrame, table: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in table.items() if a in df.columns})


def first_per(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` whole rows of each key in the given order, nulls in them included."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_valid(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """Per key and column the first non-null value; map-side combined, no sort."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns are null; a column whose types differ takes a type that holds all (text if none does)."""
    ranks = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5}
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            kinds.setdefault(c, set()).add(t)
    wide = {c: (next(iter(ts)) if len(ts) == 1 else max(ts, key=ranks.get) if ts <= set(ranks) else "string") for c, ts in kinds.items()}
    cast = [f.select(*[F.col(c).cast(wide[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def distinct_keep_nulls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key; rows with a null in the key all stay."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(whole).dropDuplicates(list(keys)).unionByName(df.where(~whole))


def without_sentinels(df: DataFrame, keys: Sequence[str], is_sentinel: Column) -> DataFrame:
    """Sentinel rows go where their key has a real row."""
    w = W.partitionBy(*keys)
    return df.withColumn("_real", F.max(~is_sentinel).over(w)).where(~is_sentinel | ~F.col("_real")).drop("_real")


def hit_join(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str = "hit") -> DataFrame:
    """Left join with a boolean that says whether a match exists."""
    return left.join(right.withColumn(flag, F.lit(True)), list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unique_or_raise(df: DataFrame, keys: Sequence[str], what: str = "key") -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{what} is not unique: {[tuple(r)[:-1] for r in twice]}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    return unique_or_raise(left, on, "left key").join(unique_or_raise(right, on, "right key"), list(on), how)


def join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    return left.join(unique_or_raise(right, on, "right key"), list(on), how)


def match_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """n_rows, n_matched, match_rate of the left side."""
    hit = hit_join(left, right.select(*on).distinct(), on, "_hit")
    return hit.agg(F.count("*").alias("n_rows"), F.count_if("_hit").alias("n_matched"), F.avg(F.col("_hit").cast("double")).alias("match_rate"))


def cascade_join(left: DataFrame, key: str, steps: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """First source that has the key gives ``value`` and names itself in ``value``_source; none leaves null and "none"."""
    out = left
    for name, table in steps:
        out = out.join(table.select(F.col(key), F.col(value).alias(f"_v_{name}")), key, "left")
    found = [F.col(f"_v_{n}") for n, _ in steps]
    source = F.lit("none")
    for n, _ in reversed(steps):
        source = F.when(F.col(f"_v_{n}").isNotNull(), n).otherwise(source)
    return out.withColumn(value, F.coalesce(*found)).withColumn(f"{value}_source", source).drop(*[f"_v_{n}" for n, _ in steps])


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all, one row with the count left after each step); counts take one pass."""
    passed, counts = F.lit(True), [F.count("*").alias("raw")]
    for name, test in steps:
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return df.where(passed), df.agg(*counts)


def occurrence_suffix(df: DataFrame, base: str, order: Sequence[Column], out: str = "uid") -> DataFrame:
    """Unique ids: the base alone where it is unique, else with the occurrence's number from 0."""
    n = F.count("*").over(W.partitionBy(base))
    i = F.row_number().over(W.partitionBy(base).orderBy(*order)) - 1
    return df.withColumn(out, F.when(n > 1, F.concat(F.col(base), F.lit("_"), i)).otherwise(F.col(base)))


def both_sides(df: DataFrame, columns: Sequence[str], sides: tuple[str, str] = ("a", "b"), keep: Sequence[str] = (), flip: Sequence[str] = ()) -> DataFrame:
    """Long form of a pair table: a row for each side, ``flip`` columns negated on the second. One scan."""
    first = F.struct(F.lit(sides[0]).alias("side"), *[F.col(f"{c}_{sides[0]}").alias(c) for c in columns], *[F.col(c).alias(c) for c in flip])
    second = F.struct(F.lit(sides[1]).alias("side"), *[F.col(f"{c}_{sides[1]}").alias(c) for c in columns], *[(-F.col(c)).alias(c) for c in flip])
    return df.select(*keep, F.explode(F.array(first, second)).alias("_s")).select(*keep, "_s.*")


def wide_to_long(df: DataFrame, keys: Sequence[str], stems: Sequence[str], labels: Sequence[str], label: str = "face") -> DataFrame:
    """Suffixed columns (stem_label) as rows; absent ones are null."""
    have = set(df.columns)
    rows = [F.struct(F.lit(x).alias(label), *[(F.col(f"{s}_{x}") if f"{s}_{x}" in have else F.lit(None)).alias(s) for s in stems]) for x in labels]
    return df.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def common_ids(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Ids that every frame has."""
    ids = reduce(lambda a, b: a.unionByName(b), [f.select(key).distinct() for f in frames.values()])
    return ids.groupBy(key).count().where(F.col("count") == len(frames)).select(key)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts with margins; a margin's key is "All"."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).select(
        F.when(F.col("_g").bitwiseAND(2) > 0, "All").otherwise(F.col(a).cast("string")).alias(a), F.when(F.col("_g").bitwiseAND(1) > 0, "All").otherwise(F.col(b).cast("string")).alias(b), "n")


def pivot_first(df: DataFrame, key: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(key).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))


def ordered_prefix(left: DataFrame, right: DataFrame, seq: str, key: str) -> DataFrame:
    """Whether the shorter id list is a prefix of the other, and the overlap of the sets."""
    a, b = left.select(seq, F.col(key).alias("a")), right.select(seq, F.col(key).alias("b"))
    at = a.join(b, seq, "inner").agg(F.coalesce(F.bool_and(F.col("a") == F.col("b")), F.lit(True)).alias("is_prefix"), F.count("*").alias("n_compared"))
    both = left.select(key).distinct().join(right.select(key).distinct(), key).agg(F.count("*").alias("n_common"))
    return at.join(F.broadcast(both), F.lit(True))


def latest_record(df: DataFrame, key: str, order: str) -> DataFrame:
    """Append-only log: the last record of each key, whole."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def entity_rollup(df: DataFrame, key: str, rank: Sequence[Column], real: Column, date: str, grade: str, grades: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """Headline row per key (first by ``rank``) with counts, first and last dates and grades over real rows."""
    g = F.upper(F.trim(F.col(grade)))
    stats = df.groupBy(key).agg(
        F.count_if(real).alias("n_real"), F.count_if(~real).alias("n_placeholder"), F.min(F.when(real, F.col(date))).alias("first_date"), F.max(F.when(real, F.col(date))).alias("last_date"),
        *[F.count_if(real & (g == x)).alias(f"n_grade_{x.lower()}") for x in grades], F.count_if(real & ~g.isin(*grades)).alias("n_grade_other"))
    return first_per(df, [key], *rank).join(stats, key, "left")


def period_growth(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(period)
    before = F.lag(value).over(w)
    return df.withColumn("previous", before).withColumn("growth", F.try_divide(F.col(value) - before, before))
