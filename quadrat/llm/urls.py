"""URL filter: domain rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models (Witten-Bell, contexts of two characters backing off to one
and none) are counted from the URLs that the rules allow and block. A URL's score is the difference of
its log-likelihoods under them, divided by its characters; the threshold is the one with the least
balanced error on a held-out fifth of the ruled URLs. All is DataFrame and SQL code. The whole URL is read, query and fragment included. Characters are
folded to 61 classes, so a model is one array of 64**3 ratios whatever the input's size.

Defined cases: a null url or one without ``://`` has empty host and path and no rule; a null or empty url has score 0; without
ruled URLs of both kinds every ratio is 0 and the verdict is allow; repeated rows are judged alike;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import staged

Rule = tuple[str, str, str]
#: (verdict, host, path)
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_~:?#[]@!$&()*+,;=%'"
OTHER = len(CHARACTERS) + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIDE = 64
#: Rules-labelled URLs whose hash falls in this share calibrate the threshold and train nothing.
HELD_OUT = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = url.isNotNull() & (F.instr(url, "://") > 0)
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """Adds _grams, the trigram numbers of a text column; the first two begin with padding."""
    quoted = CHARACTERS.replace("'", "\\'")
    codes = F.expr(f"transform(split(lower({text}), ''), c -> coalesce(nullif(instr('{quoted}', c), 0), {OTHER}))")
    padded = F.concat(F.array(F.lit(0), F.lit(0)), codes)

    def numbers(c):
        """``c`` is bound by a lambda, so the characters are coded once."""
        at = lambda i, k: F.try_element_at(c, i + k)
        return F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: at(i, 0) * SIDE * SIDE + at(i, 1) * SIDE + at(i, 2))

    grams = F.get(F.transform(F.array(padded), numbers), 0)
    return df.withColumn("_grams", F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<int>")))


def ratio_model(labelled: DataFrame) -> DataFrame:
    """One row: ``ratios``, log P(accepted) - log P(rejected) of every trigram number.

    ``labelled`` has _grams and allow (boolean). Counts are pre-aggregated in every task.
    """
    seen = labelled.select("allow", F.explode("_grams").alias("g")).groupBy("g").agg(F.count_if("allow").alias("n1"), F.count_if(~F.col("allow")).alias("n0"))
    seen = staged(seen, "url-counts")
    every = labelled.sparkSession.range(SIDE**3).select(F.col("id").cast("int").alias("g")).join(F.broadcast(seen), "g", "left").fillna(0)
    every = every.select("g", F.floor(F.col("g") / SIDE).cast("int").alias("c2"), (F.col("g") % (SIDE * SIDE)).alias("g2"), (F.floor(F.col("g") / SIDE) % SIDE).cast("int").alias("c1"), (F.col("g") % SIDE).alias("g1"), "n1", "n0")

    def level(keys: list[str]) -> DataFrame:
        """Counts of each number of this order and, for its context, total and kinds."""
        at = every.groupBy(*keys).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        ctx = at.groupBy(keys[0]).agg(*[f(k) for k in ("n1", "n0") for f in (lambda k: F.sum(k).alias("s" + k), lambda k: F.count_if(F.col(k) > 0).alias("t" + k))])
        return at.join(ctx, keys[0])

    one = every.groupBy("g1").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    total = one.agg(F.sum("n1").alias("sn1"), F.sum("n0").alias("sn0"))
    kinds = OTHER + 1
    one = one.join(F.broadcast(total), F.lit(True)).select("g1", *[((F.col(k) + 1) / (F.col("s" + k) + kinds)).alias("p" + k) for k in ("n1", "n0")])

    def back_off(df: DataFrame, keep: list[str]) -> DataFrame:
        mixed = [F.when(F.col("s" + k) > 0, (F.col(k) + F.col("t" + k) * F.col("p" + k)) / (F.col("s" + k) + F.col("t" + k))).otherwise(F.col("p" + k)).alias("p" + k) for k in ("n1", "n0")]
        return df.select(*keep, *mixed)

    two = back_off(level(["c1", "g2"]).withColumn("g1", F.col("g2") % SIDE).join(one, "g1"), ["g2"])
    three = back_off(level(["c2", "g"]).withColumn("g2", F.col("g") % (SIDE * SIDE)).join(two, "g2"), ["g"])
    both = total.select(((F.col("sn1") > 0) & (F.col("sn0") > 0)).alias("both"))
    ratio = three.join(F.broadcast(both), F.lit(True)).select("g", F.when(F.col("both"), F.ln("pn1") - F.ln("pn0")).otherwise(0.0).alias("r"))
    return ratio.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "r"))), lambda x: x["r"]).alias("ratios"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score of least balanced error; 0 when nothing is held out. Scores are binned by 0.01."""
    bins = scored.groupBy(F.least(F.lit(2000), F.greatest(F.lit(-2000), F.round(F.col("score") * 100).cast("int"))).alias("b")).agg(F.count_if("allow").alias("good"), F.count_if(~F.col("allow")).alias("bad"))
    grid = scored.sparkSession.range(-2000, 2002).select(F.col("id").cast("int").alias("b")).join(F.broadcast(bins), "b", "left").fillna(0)
    arr = grid.agg(F.array_sort(F.collect_list(F.struct("b", "good", "bad"))).alias("a"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # lost: accepted below b; let in: rejected at or above b
    walk = F.expr("aggregate(a, named_struct('lost', 0L, 'under', 0L, 'best', cast(9 as double), 'at', 0), (s, x) -> "
                  "named_struct('lost', s.lost + x.good, 'under', s.under + x.bad, "
                  "'best', least(s.best, s.lost / greatest(good, 1L) + (bad - s.under) / greatest(bad, 1L) + abs(x.b) * 1e-9), "
                  "'at', if(s.lost / greatest(good, 1L) + (bad - s.under) / greatest(bad, 1L) + abs(x.b) * 1e-9 < s.best, x.b, s.at)), s -> s.at / 100D)")
    return arr.select(F.when((F.col("good") > 0) & (F.col("bad") > 0), walk).otherwise(0.0).alias("threshold"))


def with_score(df: DataFrame, model: DataFrame) -> DataFrame:
    """Adds score, the length-normalised log-likelihood difference of a row's _grams."""
    total = F.aggregate("_grams", F.lit(0.0), lambda s, g: s + F.get("_ratios", g))
    armed = df.select("*", model.select("ratios").scalar().alias("_ratios"))
    return armed.withColumn("score", total / F.greatest(F.lit(1), F.size("_grams"))).drop("_ratios", "_grams")


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(F.col("url"), F.lit("")).alias("_text"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"))
    rows = with_grams(rows, "_text").select("page_id", "host", "path", "rule", "said", "_grams", (F.pmod(F.xxhash64("_text"), F.lit(HELD_OUT)) == 0).alias("_held"))
    ruled = rows.where(F.col("said").isNotNull()).withColumn("allow", F.col("said") == "allow")
    model = staged(ratio_model(ruled.where(~F.col("_held"))), "url-model")
    held = with_score(ruled.where("_held").select("allow", "_grams"), model)
    cut = staged(threshold(held), "url-threshold").select("threshold").scalar()
    judged = with_score(rows.drop("_held"), model)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")
