"""Words, cues and reasoning traces: rates, win rates, distinctive words and the complexity code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.functions import nested, stats, text


def word_counts(df: DataFrame, source: str, by: Sequence[str] = (), n: int = 1, least: int = 3) -> DataFrame:
    """by, word, n over tokens (or n-grams) of a text column."""
    toks = text.tokens(F.col(source), least)
    return df.select(*by, F.explode(toks if n == 1 else text.ngrams(toks, n)).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def distinctive_words(counts: DataFrame, target: Column, prior: float = 500.0, least: int = 5) -> DataFrame:
    """z of the log odds of each word in target rows against the others, with a Dirichlet prior from both.

    ``counts`` has word and n; words of fewer than ``least`` in all are left out.
    """
    w = counts.groupBy("word").agg(F.sum(F.when(target, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("p")).where(F.col("p") >= least)
    total = w.agg(F.sum("t").alias("nt"), F.sum("p").alias("np"))
    d = w.join(F.broadcast(total), F.lit(True)).withColumn("b", F.col("p") - F.col("t"))
    alpha = prior * F.col("p") / F.col("np")
    yt, yb = F.col("t") + alpha, F.col("b") + alpha
    odds = lambda y, n: F.ln(y / F.greatest(F.greatest(n, F.lit(1)) + prior - y, F.lit(1e-9)))
    z = (odds(yt, F.col("nt")) - odds(yb, F.col("np") - F.col("nt"))) / F.sqrt(1 / yt + 1 / yb)
    return d.select("word", F.col("t").alias("n_target"), F.col("b").alias("n_other"), z.alias("z"))


def exclusive_words(scores: DataFrame, block: str, score: str) -> DataFrame:
    """Each word stays with its best block; the first block name on ties."""
    w = W.partitionBy("word").orderBy(F.desc(score), block)
    return scores.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rates_per(df: DataFrame, everything: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], doc: str, per: float = 100.0) -> DataFrame:
    """Spans of each kind per ``per`` documents; the denominator counts all documents, with spans or without."""
    n = everything.groupBy(*keys).agg(F.count_distinct(doc).alias("n_docs"))
    c = df.groupBy(*keys).pivot(kind, list(kinds)).agg(F.count(F.lit(1)))
    return n.join(c, list(keys), "left").select(*keys, "n_docs", *[(F.coalesce(F.col(k), F.lit(0)) * per / F.col("n_docs")).alias(k) for k in kinds])


WINS_A, WINS_B = ("More", "MuchMore"), ("Less", "MuchLess")


def win_rates(df: DataFrame, least: int = 25, strength: float = 25.0) -> DataFrame:
    """How often the image that a cue was seen on won.

    ``df`` has pair_id, cue, image (A or B) and presented_label. One vote for each (pair, cue, image); a cue seen
    on both images of a pair is dropped; rates are shrunk towards the rate of all kept cues.
    """
    votes = df.where(F.col("image").isin("A", "B") & F.col("cue").isNotNull()).groupBy("pair_id", "cue").agg(F.min("image").alias("lo"), F.max("image").alias("hi"), F.min("presented_label").alias("label")).where("lo = hi")
    for_a, for_b = F.col("label").isin(*WINS_A), F.col("label").isin(*WINS_B)
    won = ((F.col("lo") == "A") & for_a) | ((F.col("lo") == "B") & for_b)
    t = votes.groupBy("cue").agg(F.count("*").alias("n_mentions"), F.count_if(for_a | for_b).alias("n"), F.count_if(won).alias("wins")).where(F.col("n") >= least)
    base = t.agg((F.sum("wins") / F.sum("n")).alias("base_rate"))
    lo, hi = stats.wilson(F.col("wins"), F.col("n"))
    j = t.join(F.broadcast(base), F.lit(True))
    return j.select("cue", "n_mentions", "n", "wins", (1 - F.col("n") / F.col("n_mentions")).alias("undecided_share"), (F.col("wins") / F.col("n")).alias("win_rate"), stats.shrunk(F.col("wins"), F.col("n"), F.col("base_rate"), strength).alias("shrunk_rate"), lo.alias("ci_low"), hi.alias("ci_high"), "base_rate")


def unit_win_rates(df: DataFrame, unit: str, cue: str = "cue", least: int = 10, strength: float = 25.0) -> DataFrame:
    """Win rates of (unit, cue): the side that an image was shown on is turned back by is_swapped first."""
    swapped = F.coalesce(F.col("is_swapped"), F.lit(False))
    side = F.when(swapped, F.when(F.col("image") == "A", "b").otherwise("a")).otherwise(F.when(F.col("image") == "A", "a").otherwise("b"))
    rows = df.where(F.col("image").isin("A", "B")).withColumn("_side", side).withColumn("_unit", F.when(F.col("_side") == "a", F.col(f"{unit}_a")).otherwise(F.col(f"{unit}_b"))).dropDuplicates(["pair_id", cue, "_side"])
    s = F.when(F.col("_side") == "a", F.col("relative_score")).otherwise(-F.col("relative_score"))
    t = rows.where(F.col("relative_score").isNotNull()).groupBy(F.col("_unit").alias(unit), cue).agg(F.count_if(s != 0).alias("n"), F.count_if(s > 0).alias("wins"))
    base = t.agg((F.sum("wins") / F.sum("n")).alias("base_rate"))
    return t.join(F.broadcast(base), F.lit(True)).where(F.col("n") >= least).select(unit, cue, "n", "wins", stats.shrunk(F.col("wins"), F.col("n"), F.col("base_rate"), strength).alias("shrunk_rate"))


ATTRIBUTES = f"struct<image:string,valence:string,type:string,favors:string,supporting_quotes:{nested.SPANS},justification_quotes:{nested.SPANS},condition_quotes:{nested.SPANS},mechanism:string,label:string,is_final:boolean,affects_conclusion:boolean>"
KINDS = ("dimension", "perspective", "verdict", "weighing", "dismissal", "reconsideration", "hedge")


def trace_codes(rows: DataFrame, keys: Sequence[str] = ("case", "judge_model", "doc_id"), supporting: int = 1, dimensions: int = 3, mechanisms: int = 2) -> DataFrame:
    """Components and complexity code (1 to 6) of every trace, one grouped aggregate.

    Only located ingredients count. ``keys`` name run and trace: a doc_id alone repeats between runs.
    """
    a = F.from_json("attrs_json", ATTRIBUTES)
    r = rows.withColumn("_a", a).withColumn("_real", F.col("ingredient_type").isNotNull()).withColumn("_ok", F.col("_real") & F.coalesce("quote_found", F.lit(False)))
    is_ = lambda k: F.col("_ok") & (F.col("ingredient_type") == k)
    dim, per, wei, ver, hed = (is_(k) for k in ("dimension", "perspective", "weighing", "verdict", "hedge"))
    loc = lambda f: nested.located(F.col(f"_a.{f}"))
    name = text.word_set_key(F.col("name"), (*text.STOP_WORDS, "image", "images", "photo", "photos", "picture", "pictures", "side"))
    verdict = F.when(ver, F.struct(F.col("char_start").isNull().alias("late"), F.col("char_start").alias("at"), F.col("ingredient_index").alias("i"), F.coalesce("_a.label", F.lit("")).alias("label"), F.coalesce("_a.is_final", F.lit(False)).alias("final")))
    g = r.groupBy(*keys).agg(
        F.count_if("_real").alias("n_ingredients"), F.count_if(F.col("_real") & ~F.col("_ok")).alias("n_unlocated"), F.coalesce(F.bool_or("answer_truncated"), F.lit(False)).alias("truncated"),
        *[F.count_if(is_(k)).alias(f"n_{k}") for k in KINDS],
        F.size(F.collect_set(F.when(dim & (name != ""), name))).alias("n_dimensions_distinct"),
        F.collect_set(F.when(dim, F.col("_a.image"))).alias("_images"), F.collect_set(F.when(dim, F.col("_a.valence"))).alias("_valences"), F.count_if(dim & (F.col("_a.type") == "evaluative")).alias("n_evaluative"),
        F.count_if(per & (loc("supporting_quotes") >= supporting)).alias("n_perspectives_developed"), F.collect_set(F.when(per, F.col("_a.favors"))).alias("_favors"),
        F.count_if(wei & (loc("justification_quotes") >= 1)).alias("n_weighings_justified"), F.count_if(wei & ((loc("condition_quotes") >= 1) | F.coalesce(F.col("_a.mechanism") == "conditional", F.lit(False)))).alias("n_weighings_conditional"),
        F.array_sort(F.collect_set(F.when(wei & (F.col("_a.mechanism") != ""), F.col("_a.mechanism")))).alias("_mech"),
        F.count_if(hed & (loc("justification_quotes") >= 1)).alias("n_hedges_justified"), F.coalesce(F.bool_or(F.when(hed, F.col("_a.affects_conclusion"))), F.lit(False)).alias("hedge_affects_conclusion"),
        F.array_sort(F.collect_list(verdict)).alias("_verdicts"))
    has = lambda c, *xs: F.forall(F.array(*map(F.lit, xs)), lambda x: F.array_contains(c, x))
    labels = F.filter(F.transform("_verdicts", lambda v: v["label"]), lambda x: x != "")
    finals = F.transform(F.filter("_verdicts", lambda v: v["final"]), lambda v: v["label"])
    g = g.withColumns({
        "dimensions_both_images": has(F.col("_images"), "A", "B") | F.array_contains("_images", "both"), "dimensions_both_valences": has(F.col("_valences"), "good", "bad"),
        "perspectives_both_sides": has(F.col("_favors"), "A", "B"), "verdict_revised": F.size(F.array_distinct(labels)) > 1,
        "verdict_final": F.coalesce(F.try_element_at(finals, F.lit(-1)), F.try_element_at(labels, F.lit(-1)), F.lit("")),
        "verdict_labels": F.array_join(labels, "|"), "mechanisms": F.array_join("_mech", "|"), "n_mechanisms": F.size("_mech")})
    many = F.col("n_dimensions_distinct") >= dimensions
    two = F.col("dimensions_both_images") | F.col("dimensions_both_valences")
    g = g.withColumn("differentiated", (F.col("n_perspectives_developed") >= 2) | ((F.col("n_perspectives_developed") >= 1) & F.col("perspectives_both_sides")) | (many & two))
    g = g.withColumn("pseudo_differentiation", many & ~two & (F.col("n_perspectives_developed") == 0))
    g = g.withColumn("integrated", (F.col("n_weighings_justified") >= 1) & F.col("differentiated")).withColumn("context_sensitive", (F.col("n_weighings_conditional") >= 1) | (F.col("n_mechanisms") >= mechanisms))
    links = (F.col("n_weighing") >= 1) | F.col("verdict_revised") | (F.col("n_reconsideration") >= 1)
    code = F.when(F.col("integrated") & F.col("context_sensitive"), 6).when(F.col("integrated"), 5).when(F.col("differentiated") & links, 4).when(F.col("differentiated"), 3).when((F.col("n_hedge") >= 1) | (F.col("n_dismissal") >= 1), 2).otherwise(1)
    return g.withColumn("ic_code", code).drop("_images", "_valences", "_favors", "_mech", "_verdicts")


def code_summary(codes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean, median and share of each code, cut traces left out."""
    whole = codes.where(~F.col("truncated"))
    return whole.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ic_code").alias("mean_code"), F.median("ic_code").alias("median_code"), *[F.avg((F.col("ic_code") == k).cast("double")).alias(f"share_{k}") for k in range(1, 7)])


def verify_claims(df: DataFrame, claims: str, evidence: str, k: int = 3) -> DataFrame:
    """Per claim the ``k`` evidence sentences with the largest word overlap, best first; a stand-in for a scoring model."""
    words = lambda c: F.array_distinct(text.tokens(c))
    sent = text.sentences(F.col(evidence), 10)
    scored = F.transform(sent, lambda s: F.struct((-stats.jaccard(words(F.col(claims)), words(s))).alias("d"), s.alias("s")))
    return df.withColumn("evidence_top", F.transform(F.slice(F.array_sort(scored), 1, k), lambda x: F.struct(x["s"].alias("sentence"), (-x["d"]).alias("score"))))
