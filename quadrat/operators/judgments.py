"""Labels of pairwise judgments, their diagnostics, agreement and group tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.functions import stats
from quadrat.functions.columns import hash_bucket
from quadrat.operators.sampling import sums_before

#: The ordinal scale, lowest first, and the label of abstention: fixed values.
LABELS = ("MuchLess", "Less", "Same", "More", "MuchMore")
NOT_SURE = "NotSure"
#: Spellings after lower-casing and removal of spaces, hyphens and underscores: fixed values.
ALIASES = {
    "muchless": "MuchLess", "less": "Less", "same": "Same", "equal": "Same", "more": "More", "muchmore": "MuchMore",
    "yes": "More", "no": "Less", "true": "More", "false": "Less",
    "notsure": NOT_SURE, "unsure": NOT_SURE, "cannottell": NOT_SURE, "canttell": NOT_SURE, "unclear": NOT_SURE, "unknown": NOT_SURE, "idk": NOT_SURE,
}


def _map(c: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def canonical_label(answer: Column, abstain: str = NOT_SURE) -> Column:
    """Label of a free answer: configured abstention, known spelling, abstaining phrase, contained label, else Same."""
    raw = F.lower(F.trim(F.coalesce(answer.cast("string"), F.lit(""))))
    norm = F.translate(raw, "_- ", "")
    own = abstain.lower().translate(str.maketrans("", "", "_- "))
    out = F.coalesce(_map(norm, ALIASES), F.when(norm.contains("notsure") | norm.contains("unsure") | norm.contains("cannottell"), NOT_SURE))
    # compound labels stand before the words that they contain
    for label in ("MuchLess", "MuchMore", "Less", "More", "Same"):
        out = F.coalesce(out, F.when(raw.contains(label.lower()), label))
    out = F.coalesce(out, F.lit("Same"))
    if own:
        out = F.when((raw != "") & norm.contains(own), NOT_SURE).otherwise(out)
    return out


def inverted(label: Column) -> Column:
    return F.coalesce(_map(label, {**dict(zip(LABELS, reversed(LABELS))), NOT_SURE: NOT_SURE}), F.lit("Same"))


def ordinal(label: Column) -> Column:
    """-2 to 2; null for abstention and anything else."""
    return _map(label, {x: i - 2 for i, x in enumerate(LABELS)})


def derive_labels(df: DataFrame, answer: str = "answer", swapped: str = "is_swapped", abstain: str = NOT_SURE) -> DataFrame:
    """presented_* is about what was shown, relative_* always about a against b."""
    flip = F.coalesce(F.col(swapped), F.lit(False)) if swapped in df.columns else F.lit(False)
    shown = canonical_label(F.col(answer) if answer in df.columns else F.lit(""), abstain)
    out = df.withColumn("presented_label", shown).withColumn("presented_score", ordinal(F.col("presented_label")))
    out = out.withColumn("relative_label", F.when(flip, inverted(F.col("presented_label"))).otherwise(F.col("presented_label")))
    return out.withColumn("relative_score", ordinal(F.col("relative_label")))


def debug_label(pair_id: Column, seed: object, labels: Sequence[str] = LABELS) -> Column:
    """Label by hash, the same everywhere: lets a pipeline run without a model."""
    return F.get(F.array(*map(F.lit, labels)), hash_bucket(pair_id, seed, len(labels)))


def label_distribution(df: DataFrame, label: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Every label in order, then other: n and share, zeros included."""
    order = [*labels, "other"]
    known = F.when(F.col(label).isin(*labels), F.col(label)).otherwise("other")
    counts = df.groupBy(known.alias("label")).agg(F.count("*").alias("n"))
    dim = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(order)], "position int, label string")
    joined = F.broadcast(dim).join(counts, "label", "left").fillna(0, ["n"])
    return joined.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())), F.lit(0.0)))


def label_diagnostics(df: DataFrame, label: str, missing: Column, keys: Sequence[str] = ()) -> DataFrame:
    """n, missing_rate, n_labels, majority_share, entropy (nats) for each group."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("c"), F.count_if(missing).alias("m"))
    return counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), (F.sum("m") / F.sum("c")).alias("missing_rate"), F.count("*").alias("n_labels"),
        (F.max("c") / F.sum("c")).alias("majority_share"), stats.entropy(F.collect_list("c")).alias("entropy"))


def position_bias(df: DataFrame, order: str, label: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Row-normalized shares of labels for each presented order."""
    total = F.count("*")
    return df.groupBy(order).agg(*[(F.count_if(F.col(label) == x) / total).alias(x) for x in labels], total.alias("n"))


def repeat_consistency(df: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """Groups with two or more scored rows: exact and sign agreement rates, mean population variance, mean span."""
    g = df.where(F.col(score).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("k"), (F.count_distinct(score) == 1).alias("exact"), (F.count_distinct(F.signum(score)) == 1).alias("sign"),
        F.var_pop(score).alias("var"), (F.max(score) - F.min(score)).alias("span")).where("k >= 2")
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return g.agg(F.count("*").alias("n_groups"), rate("exact").alias("exact_rate"), rate("sign").alias("sign_rate"), F.avg("var").alias("mean_variance"), F.avg("span").alias("mean_span"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n over rows where both are present."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def kappa(df: DataFrame, a: str, b: str, weight: str = "none") -> DataFrame:
    """n, observed agreement, kappa (none, linear or quadratic weights) from the contingency table."""
    t = contingency(df, a, b)
    total = t.agg(F.sum("n").alias("total"))
    if weight == "none":
        w = F.when(F.col("a") == F.col("b"), 0.0).otherwise(1.0)
    else:
        w = F.pow(F.abs(F.col("a") - F.col("b")), 1 if weight == "linear" else 2).cast("double")
    left, right = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    # a product of two label lists, each as long as the scale
    chance = left.join(right, F.lit(True)).agg(F.sum(w * F.col("na") * F.col("nb")).alias("chance"))
    seen = t.agg(F.sum(w * F.col("n")).alias("seen"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    row = seen.join(chance, F.lit(True)).join(total, F.lit(True))
    return row.select(F.col("total").alias("n"), F.try_divide(F.col("same"), F.col("total")).alias("agreement"), (1 - F.try_divide(F.col("seen") * F.col("total"), F.col("chance"))).alias("kappa"))


def krippendorff_alpha(df: DataFrame, unit: str, score: str) -> DataFrame:
    """Interval alpha over units with two or more ratings, from coincidence sums."""
    u = df.where(F.col(score).isNotNull()).groupBy(unit).agg(F.count("*").alias("m"), F.sum(score).alias("s"), F.sum(F.col(score) * F.col(score)).alias("q")).where("m >= 2")
    n, s, q = F.sum("m"), F.sum("s"), F.sum("q")
    within = F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)) / n
    between = 2 * (n * q - s * s) / (n * (n - 1))
    return u.agg(n.alias("n"), (1 - F.try_divide(within, between)).alias("alpha"))


def paired_metrics(base: DataFrame, probe: DataFrame, key: str, score: str) -> DataFrame:
    """Base and probe scores of the same pairs: n, exact and sign agreement, mean absolute difference, correlation."""
    j = base.select(key, F.col(score).alias("x")).join(probe.select(key, F.col(score).alias("y")), key).where("x is not null and y is not null")
    return j.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("exact"), F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"), F.corr("x", "y").alias("corr"))


def repeat_agreement(df: DataFrame, canonical: str, repeat: str, score: str) -> DataFrame:
    """First showing against later ones of the same canonical pair."""
    first = df.where(F.col(repeat) == 0).select(canonical, F.col(score).alias("x"))
    later = df.where(F.col(repeat) > 0).select(canonical, F.col(score).alias("y"))
    j = first.join(later, canonical).where("x is not null and y is not null")
    return j.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("exact"), F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign"))


def split_halves(df: DataFrame, swapped: str, unit_a: str, unit_b: str, score: str) -> DataFrame:
    """Mean unit scores from swapped and from unswapped rows, and their correlation."""
    side = lambda u, s: F.struct(F.col(u).alias("unit"), (F.col(score) * s).alias("v"), F.col(swapped).alias("half"))
    long = df.where(F.col(score).isNotNull()).select(F.explode(F.array(side(unit_a, 1), side(unit_b, -1))).alias("e")).select("e.*")
    halves = long.groupBy("unit").agg(F.avg(F.when(F.col("half"), F.col("v"))).alias("x"), F.avg(F.when(~F.col("half"), F.col("v"))).alias("y")).where("x is not null and y is not null")
    return halves.agg(F.count("*").alias("n_units"), F.corr("x", "y").alias("corr"))


def attach_groups(df: DataFrame, groups: DataFrame, unit: str = "unit_uid", group: str = "group") -> DataFrame:
    """group_a and group_b for both sides; the first group of a unit wins."""
    one = groups.where(F.col(group).isNotNull()).groupBy(unit).agg(F.min(group).alias(group))
    out = df
    for s in ("a", "b"):
        out = out.join(one.select(F.col(unit).alias(f"{unit}_{s}"), F.col(group).alias(f"group_{s}")), f"{unit}_{s}", "left")
    return out


def head_to_head(df: DataFrame, group_a: str, group_b: str, canonical: str = "canonical_pair_id", score: str = "relative_score") -> DataFrame:
    """Direct comparisons oriented towards ``group_a``, repeats averaged: mean, SE, t, p, win rate with Wilson interval, Cohen d."""
    ab, ba = (F.col("group_a") == group_a) & (F.col("group_b") == group_b), (F.col("group_a") == group_b) & (F.col("group_b") == group_a)
    rows = df.where((ab | ba) & F.col(score).isNotNull()).select(canonical, F.when(ab, F.col(score)).otherwise(-F.col(score)).cast("double").alias("x"))
    per = rows.groupBy(canonical).agg(F.avg("x").alias("x"), F.count("*").alias("k"))
    m = per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_obs"), F.count("*").alias("n_pairs"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count_if(F.col("x") > 0).alias("wins"), F.count_if(F.col("x") < 0).alias("losses"))
    lo, hi = stats.wilson(F.col("wins"), F.col("wins") + F.col("losses"), empty=(None, None))
    se = F.col("sd") / F.sqrt("n_pairs")
    t = F.try_divide(F.col("mean"), se)
    return m.select("n_obs", "n_pairs", "mean", se.alias("se"), t.alias("t"), stats.normal_two_sided(t).alias("p_normal"), "wins", "losses", F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")).alias("win_rate"), lo.alias("win_lo"), hi.alias("win_hi"), F.try_divide(F.col("mean"), F.col("sd")).alias("cohens_d"))


def rating_level(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Two groups of ratings: means, Welch t, Mann-Whitney U by average ranks, Cliff delta, Cohen d."""
    two = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    ties = two.groupBy(value).agg(F.count("*").alias("c"), F.count_if(F.col(group) == a).alias("ca"))
    # ranks over distinct values, numbered over range partitions
    u = sums_before(ties, [value], "c", "below").withColumn("rank", F.col("below") + (F.col("c") + 1) / 2).agg(F.sum(F.col("rank") * F.col("ca")).alias("ranks_a"))
    g = lambda x, f, n: f(F.when(F.col(group) == x, F.col(value))).alias(n)
    m = two.agg(*[g(x, f, f"{n}_{k}") for x, k in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))]).join(u, F.lit(True))
    c = F.col
    t, df_ = stats.welch_t(c("mean_a"), c("var_a"), c("n_a"), c("mean_b"), c("var_b"), c("n_b"))
    us = c("ranks_a") - c("n_a") * (c("n_a") + 1) / 2
    return m.select("n_a", "n_b", "mean_a", "mean_b", (c("mean_a") - c("mean_b")).alias("delta"), t.alias("welch_t"), df_.alias("welch_df"), us.alias("mann_whitney_u"), (2 * F.try_divide(us, c("n_a") * c("n_b")) - 1).alias("cliffs_delta"), stats.cohens_d(c("mean_a"), c("var_a"), c("n_a"), c("mean_b"), c("var_b"), c("n_b")).alias("cohens_d"))


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q", keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted p within each family; null p passes through."""
    have = F.col(p).isNotNull()
    fam = W.partitionBy(*keys, have)
    n, r = F.count(p).over(fam), F.row_number().over(fam.orderBy(p))
    raw = F.col(p) * n / r
    down = fam.orderBy(F.col(p).desc(), F.col("_r").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = df.withColumn("_r", r).withColumn("_q", raw)
    return ranked.withColumn(out, F.when(have, F.least(F.lit(1.0), F.min("_q").over(down)))).drop("_r", "_q")


def replication(df: DataFrame, comparison: Sequence[str], effect: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Per comparison over models: directions, significant ones, mean effect, whether all signs agree."""
    e = F.col(effect)
    return df.groupBy(*comparison).agg(F.count(effect).alias("n_models"), F.count_if(e > 0).alias("n_positive"), F.count_if(e < 0).alias("n_negative"), F.count_if(F.col(p) < alpha).alias("n_significant"), F.avg(F.when(~F.isnan(e), e)).alias("mean_effect"), (F.count_distinct(F.signum(F.when(e != 0, e))) == 1).alias("all_same_sign"))


def score_units(df: DataFrame, unit: str, score: str, least: int = 1) -> DataFrame:
    """Mean, deviation and count of each unit's oriented scores, and its rate of abstentions (null scores)."""
    side = lambda s, f: F.struct(F.col(f"{unit}_{s}").alias(unit), (F.col(score) * f).alias("v"))
    long = df.select(F.explode(F.array(side("a", 1), side("b", -1))).alias("e")).select("e.*").where(F.col(unit).isNotNull())
    return long.groupBy(unit).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.avg(F.col("v").isNull().cast("double")).alias("abstention_rate")).where(F.col("n") >= least)


def zscore_ensemble(df: DataFrame, model: str, unit: str, value: str) -> DataFrame:
    """Values standardized within each model, then mean, population deviation, min, max and count over models."""
    w = W.partitionBy(model)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return df.withColumn("_z", F.coalesce(z, F.lit(0.0))).groupBy(unit).agg(F.avg("_z").alias("mean_z"), F.stddev_pop("_z").alias("std_z"), F.min("_z").alias("min_z"), F.max("_z").alias("max_z"), F.count("*").alias("n_models"))


def classifier_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Confusion counts and rates of two booleans."""
    t, g = F.col(truth), F.col(guess)
    c = df.where(t.isNotNull() & g.isNotNull()).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    d = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double"))
    f1p, f1n = d("2 * tp", "2 * tp + fp + fn"), d("2 * tn", "2 * tn + fp + fn")
    return c.select("tp", "fp", "fn", "tn", d("tp + tn", "tp + fp + fn + tn").alias("accuracy"), d("tp", "tp + fp").alias("precision"), d("tp", "tp + fn").alias("recall"), d("tn", "tn + fn").alias("npv"), d("fn", "tn + fn").alias("false_omission"), ((F.coalesce(f1p, F.lit(0.0)) + F.coalesce(f1n, F.lit(0.0))) / 2).alias("macro_f1"))


def high_variance(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.var_pop(score).alias("variance"), F.count(score).alias("n")).where("n >= 2").orderBy(F.desc("variance"), key).limit(k)
