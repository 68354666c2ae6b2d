"""Queries over judgments, samples, traces and composites, beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import judgments, sampling, spans
from quadrat.plans import analysis
from quadrat.queries_curation import ZONES, scratch, square, zone_inputs
from quadrat.registry import query, rnd, t

# --- judgments

ANSWERS = ["much_more", " Less ", "NOT SURE", "can't tell", "about the same", "definitely more", "", "yes", "blah"]
LABELS = ["MuchMore", "Less", "NotSure", "Same", "Same", "More", "Same", "More", "Same"]
SCORES = {"MuchLess": -2, "Less": -1, "Same": 0, "More": 1, "MuchMore": 2}
FLIPPED = {"MuchLess": "MuchMore", "Less": "More", "Same": "Same", "More": "Less", "MuchMore": "MuchLess", "NotSure": "NotSure"}


def sql_case(column: str, table: dict, kind: str = "INTEGER") -> str:
    return f"CAST(CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items()) + f" END AS {kind})"


def answer(k):
    return F.get(F.array(*map(F.lit, ANSWERS)), (k % len(ANSWERS)).cast("int"))


DERIVED = f"SELECT o_orderkey, o_custkey, o_orderkey % 4 = 0 AS swapped, {LABELS!r}[(o_orderkey % {len(LABELS)} + 1)::INTEGER] AS shown FROM orders"


@query(f"""
WITH a AS ({DERIVED}), r AS (SELECT *, CASE WHEN swapped THEN {sql_case('shown', FLIPPED, 'VARCHAR')} ELSE shown END AS rel FROM a)
SELECT o_orderkey, shown AS presented_label, {sql_case('shown', SCORES)} AS presented_score, rel AS relative_label, {sql_case('rel', SCORES)} AS relative_score FROM r""")
def q_derive_labels(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", answer(F.col("o_orderkey")).alias("answer"), (F.col("o_orderkey") % 4 == 0).alias("is_swapped"))
    return judgments.derive_labels(o).select("o_orderkey", "presented_label", "presented_score", "relative_label", "relative_score")


@query("""
WITH g AS (SELECT s_nationkey AS u, min('g' || s_suppkey % 3) AS g FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1)
SELECT o_orderkey, a.g AS group_a, b.g AS group_b FROM orders LEFT JOIN g a ON a.u = o_custkey % 40 LEFT JOIN g b ON b.u = o_orderkey % 40""")
def q_attach_groups(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).cast("int").alias("unit_uid_a"), (F.col("o_orderkey") % 40).cast("int").alias("unit_uid_b"))
    g = t(spark, d, "supplier").select(F.col("s_nationkey").alias("unit_uid"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("g"), (F.col("s_suppkey") % 3).cast("string"))).alias("group"))
    return judgments.attach_groups(o, g).select("o_orderkey", "group_a", "group_b")


@query("""
WITH j AS (SELECT (o_orderkey % 5 - 2) AS x, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 5 - 2 END AS y FROM orders WHERE o_orderkey % 3 <> 0)
SELECT count(*) AS n, round(avg((x = y)::INT), 6) AS exact, round(avg((sign(x) = sign(y))::INT), 6) AS sign, round(avg(abs(x - y)), 6) AS mean_abs_diff, round(corr(x, y), 6) AS corr FROM j WHERE y IS NOT NULL""")
def q_paired_metrics(spark, d):
    o = t(spark, d, "orders")
    a = o.select("o_orderkey", (F.col("o_orderkey") % 5 - 2).alias("s"))
    b = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 5 - 2).alias("s"))
    return judgments.paired_metrics(a, b, "o_orderkey", "s").select("n", *[rnd(c).alias(c) for c in ("exact", "sign", "mean_abs_diff", "corr")])


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber - 1 AS r, l_partkey % 5 - 2 AS s FROM lineitem) SELECT count(*) AS n, round(avg((a.s = b.s)::INT), 6) AS exact, round(avg((sign(a.s) = sign(b.s))::INT), 6) AS sign FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.r = 0 AND b.r > 0""")
def q_repeat_agreement(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("r"), (F.col("l_partkey") % 5 - 2).alias("s"))
    return judgments.repeat_agreement(x, "l_orderkey", "r", "s").select("n", rnd("exact").alias("exact"), rnd("sign").alias("sign"))


@query("""
WITH l AS (SELECT l_partkey % 50 AS u, l_quantity AS v, l_linenumber % 2 = 0 AS h FROM lineitem UNION ALL SELECT l_suppkey % 50, -l_quantity, l_linenumber % 2 = 0 FROM lineitem), m AS (SELECT u, avg(v) FILTER (WHERE h) AS x, avg(v) FILTER (WHERE NOT h) AS y FROM l GROUP BY u)
SELECT count(*) AS n_units, round(corr(x, y), 6) AS corr FROM m WHERE x IS NOT NULL AND y IS NOT NULL""")
def q_split_halves(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_linenumber") % 2 == 0).alias("swapped"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"), "l_quantity")
    return judgments.split_halves(x, "swapped", "a", "b", "l_quantity").withColumn("corr", rnd("corr"))


@query("""
SELECT c_nationkey, count(c_acctbal) AS n_models, count(*) FILTER (WHERE c_acctbal > 0) AS n_positive, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative, count(*) FILTER (WHERE (c_custkey % 100) / 100.0 < 0.05) AS n_significant, round(avg(c_acctbal), 6) AS mean_effect, count(DISTINCT sign(nullif(c_acctbal, 0))) = 1 AS all_same_sign FROM customer GROUP BY 1""")
def q_replication(spark, d):
    c = t(spark, d, "customer").withColumn("p", (F.col("c_custkey") % 100) / 100.0)
    return judgments.replication(c, ["c_nationkey"], "c_acctbal", "p").withColumn("mean_effect", rnd("mean_effect"))


@query("""
WITH r AS (SELECT DISTINCT user_id AS pair_id, event_type AS cue, CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END ELSE CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END END AS side, user_id % 5 - 2 AS sc, user_id % 7 AS ua, user_id % 11 AS ub FROM events),
v AS (SELECT CASE side WHEN 'a' THEN ua ELSE ub END AS unit, cue, CASE side WHEN 'a' THEN sc ELSE -sc END AS s FROM r), g AS (SELECT unit, cue, count(*) FILTER (WHERE s <> 0) AS n, count(*) FILTER (WHERE s > 0) AS wins FROM v GROUP BY ALL), b AS (SELECT sum(wins) / sum(n) AS base FROM g)
SELECT unit, cue, n, wins, round((wins + 25 * base) / (n + 25), 6) AS shrunk_rate FROM g, b WHERE n >= 2""")
def q_unit_win_rates(spark, d):
    u = F.col("user_id")
    e = t(spark, d, "events").select(u.alias("pair_id"), F.col("event_type").alias("cue"), F.when(F.col("event_id") % 3 == 0, "A").otherwise("B").alias("image"), (u % 2 == 0).alias("is_swapped"), (u % 5 - 2).alias("relative_score"), (u % 7).alias("unit_a"), (u % 11).alias("unit_b"))
    return spans.unit_win_rates(e, "unit", least=2).withColumn("shrunk_rate", rnd("shrunk_rate"))


@query("""
SELECT c_mktsegment, count(*) AS n, round(avg(code), 6) AS mean_code, round(median(code), 6) AS median_code, round(avg((code = 1)::INT), 6) AS share_1, round(avg((code = 6)::INT), 6) AS share_6 FROM (SELECT c_mktsegment, c_custkey % 6 + 1 AS code FROM customer WHERE c_custkey % 9 <> 0) GROUP BY 1""")
def q_code_summary(spark, d):
    c = t(spark, d, "customer").select("c_mktsegment", (F.col("c_custkey") % 6 + 1).alias("ic_code"), (F.col("c_custkey") % 9 == 0).alias("truncated"))
    return spans.code_summary(c, ["c_mktsegment"]).select("c_mktsegment", "n", *[rnd(x).alias(x) for x in ("mean_code", "median_code", "share_1", "share_6")])


@query("""
WITH r AS (SELECT conv_id, count(*) FILTER (WHERE k = 0) AS nd, count(*) FILTER (WHERE k = 1) AS np, count(*) FILTER (WHERE k = 2) AS nw, count(*) FILTER (WHERE k = 3) AS nh FROM (SELECT conv_id, (conv_id + turn) % 4 AS k FROM conversations) GROUP BY 1)
SELECT conv_id AS doc_id, nd + np + nw + nh AS n_ingredients, np >= 2 OR nd >= 3 AS differentiated, (np >= 2 OR nd >= 3) AND nw >= 1 AS integrated, CASE WHEN (np >= 2 OR nd >= 3) AND nw >= 1 THEN 5 WHEN np >= 2 OR nd >= 3 THEN 3 WHEN nh >= 1 THEN 2 ELSE 1 END::INTEGER AS ic_code FROM r""")
def q_code_rules(spark, d):
    """The code's rules on ingredients of four kinds whose attributes are fixed: both images, developed perspectives, justified weighings."""
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    c = t(spark, d, "conversations")
    quotes = F.array(F.struct(F.lit("q").alias("text"), F.lit("exact").alias("method")))
    attrs = F.to_json(F.struct(F.lit("both").alias("image"), quotes.alias("supporting_quotes"), quotes.alias("justification_quotes"), F.lit("").alias("mechanism")))
    # names are told apart by letters, of which there are enough for any conversation's turns
    letters = F.concat_ws("", F.transform(F.split(F.lpad(F.col("turn").cast("string"), 6, "0"), ""), lambda x: F.translate(x, "0123456789", "abcdefghij")))
    r = c.select(F.lit("demo").alias("case"), F.lit("m").alias("judge_model"), F.col("conv_id").alias("doc_id"), F.when(k == 0, "dimension").when(k == 1, "perspective").when(k == 2, "weighing").otherwise("hedge").alias("ingredient_type"), F.col("turn").cast("int").alias("ingredient_index"), letters.alias("name"), F.lit(True).alias("quote_found"), F.lit(False).alias("answer_truncated"), F.col("turn").cast("int").alias("char_start"), attrs.alias("attrs_json"))
    return spans.trace_codes(r).select("doc_id", "n_ingredients", "differentiated", "integrated", "ic_code")


# --- samples: what holds whatever the hash draws

@query("SELECT c_mktsegment, 20::BIGINT AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def q_stratified_sizes(spark, d):
    c = t(spark, d, "customer")
    k = c.select("c_mktsegment").distinct().count() * 20
    got = sampling.stratified(c, "c_mktsegment", k, 3, "c_custkey").select("c_custkey").distinct().join(c, "c_custkey")
    return got.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, floor(count(*) * 0.8)::BIGINT AS n_train, count(*) - floor(count(*) * 0.8)::BIGINT AS n_test FROM customer GROUP BY 1")
def q_split_sizes(spark, d):
    s = sampling.split_within(t(spark, d, "customer"), "c_mktsegment", 0.8, 5, "c_custkey")
    return s.groupBy("c_mktsegment").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))


@query("SELECT c_mktsegment, c_nationkey, least(count(*), 3) AS n FROM customer GROUP BY ALL")
def q_per_cell_sizes(spark, d):
    s = sampling.per_cell(t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], 3, 1, "c_custkey")
    return s.groupBy("c_mktsegment", "c_nationkey").agg(F.count_distinct("c_custkey").alias("n"))


@query("SELECT least(4 * n, n * (n - 1) // 2)::BIGINT AS n_pairs, least(4 * n, n * (n - 1) // 2)::BIGINT AS n_distinct, 0::BIGINT AS n_bad, 2 * least(4 * n, n * (n - 1) // 2)::BIGINT AS n_presented, least(4 * n, n * (n - 1) // 2)::BIGINT AS n_swapped FROM (SELECT count(*) AS n FROM customer)")
def q_pair_properties(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    p = sampling.distinct_pairs(c, "c_custkey", 4 * c.count(), 9)
    known = p.join(c.withColumnRenamed("c_custkey", "a"), "a", "left_semi").join(c.withColumnRenamed("c_custkey", "b"), "b", "left_semi")
    shown = sampling.pair_table(p, 2).agg(F.count("*").alias("n_presented"), F.count_if("is_swapped").alias("n_swapped"))
    good = known.agg(F.count_if(F.col("a") != F.col("b")).alias("n_good"))
    return p.agg(F.count("*").alias("n_pairs"), F.count_distinct(F.least("a", "b"), F.greatest("a", "b")).alias("n_distinct")).join(good, F.lit(True)).join(shown, F.lit(True)).select("n_pairs", "n_distinct", (F.col("n_pairs") - F.col("n_good")).alias("n_bad"), "n_presented", "n_swapped")


@query("SELECT n * (n - 1) // 2 AS n_pairs, 0::BIGINT AS n_foreign, 0::BIGINT AS n_weightless FROM (SELECT count(DISTINCT c_nationkey) AS n FROM customer)")
def q_unit_pair_properties(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", "c_custkey", F.greatest(F.lit(0.0), F.col("c_acctbal")).alias("w"))
    p = sampling.unit_pairs(c, "c_nationkey", "c_custkey", "w", 10_000, 4)
    total = F.sum("w").over(sampling.W.partitionBy("c_nationkey"))
    have = c.select("c_nationkey", "c_custkey", ((F.col("w") == 0) & (total > 0)).alias("weightless"))
    side = lambda s: p.join(have.select(F.col("c_nationkey").alias(f"unit_{s}"), F.col("c_custkey").alias(f"image_{s}"), F.col("weightless")), [f"unit_{s}", f"image_{s}"], "left").agg(F.count_if(F.col("weightless").isNull()).alias(f"f{s}"), F.count_if("weightless").alias(f"w{s}"))
    return p.agg(F.count("*").alias("n_pairs")).join(side("a"), F.lit(True)).join(side("b"), F.lit(True)).select("n_pairs", (F.col("fa") + F.col("fb")).alias("n_foreign"), (F.col("wa") + F.col("wb")).alias("n_weightless"))


@query("SELECT m AS n_pairs, 2 * m AS n_ids FROM (SELECT count(*) // 2 AS m FROM customer)")
def q_matching_properties(spark, d):
    m = sampling.perfect_matching(t(spark, d, "customer").select("c_custkey"), "c_custkey", 3)
    return m.select(F.explode(F.array("a", "b")).alias("x")).agg((F.count("*") / 2).cast("long").alias("n_pairs"), F.count_distinct("x").alias("n_ids"))


@query("SELECT r::INTEGER AS rank, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) GROUP BY r")
def q_interleave_ranks(spark, d):
    s = sampling.interleave(t(spark, d, "customer"), "c_mktsegment", 2, "c_custkey")
    return s.select(F.col("position._r").alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) FILTER (WHERE r <= round_even(n * 0.7, 0)) AS n_train, count(*) FILTER (WHERE r > round_even(n * 0.7, 0) AND r <= round_even(n * 0.85, 0)) AS n_dev FROM (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) GROUP BY 1")
def q_split_ratios(spark, d):
    s = sampling.split_ratios(t(spark, d, "customer"), "c_mktsegment", {"train": 0.7, "dev": 0.15, "test": 0.15}, 4, "c_custkey")
    return s.groupBy("c_mktsegment").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "dev").alias("n_dev"))


# --- composites

@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0 GROUP BY 1")
def q_quotable(spark, d):
    e = t(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 != 0, "match_exact").alias("alignment_status"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("event_type")).alias("extraction_class"))
    return analysis.quotable(e).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2, 3) THEN 'parks' ELSE 'plazas' END AS part FROM customer WHERE c_nationkey IN (1, 2, 3, 7, 8)")
def q_split_population(spark, d):
    return analysis.split_population(t(spark, d, "customer"), "c_nationkey", {"parks": [1, 2, 3], "plazas": [3, 7, 8]}).select("c_custkey", "part")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE length(text) >= 400) AS n_kept, round(avg(length(text)) FILTER (WHERE length(text) >= 400), 4) AS mean_chars, max(length(text)) FILTER (WHERE length(text) >= 400)::INTEGER AS max_chars FROM documents")
def q_long_enough(spark, d):
    return analysis.long_enough(t(spark, d, "documents"), "text", 400)[1].withColumn("mean_chars", rnd("mean_chars", 4))


@query("""
WITH e AS (SELECT l_orderkey, count(*) AS e FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT o_orderstatus, count(*) AS n_traces, coalesce(sum(e), 0)::BIGINT AS n_extractions, round(coalesce(sum(e), 0) / count(*), 6) AS per_trace, count(*) FILTER (WHERE e IS NULL) AS n_silent, 0::BIGINT AS n_repeated FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY 1""")
def q_merge_summary(spark, d):
    o = t(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    x = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).join(o, "o_orderkey")
    return analysis.merge_summary(o, x, "o_orderstatus", "o_orderkey").withColumn("per_trace", rnd("per_trace"))


@query("SELECT c_nationkey, round(avg(c_acctbal), 6) AS lat, round(avg(c_custkey), 6) AS lon, count(*) AS n_images FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def q_unit_locations(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("lat"), F.col("c_custkey").alias("lon"))
    return analysis.unit_locations(c, "c_nationkey", "lat", "lon").withColumn("lat", rnd("lat")).withColumn("lon", rnd("lon"))


@query(ZONES + ", s AS (SELECT c_custkey, c_nationkey * 1.0 AS val FROM customer) SELECT zone, count(DISTINCT s.c_custkey) AS n_units, round(avg(val), 6) AS mean, round(stddev_samp(val), 6) AS std, nullif(count(DISTINCT val), 0) AS n_values FROM z LEFT JOIN p ON x >= zx - 400 AND x < zx + 400 AND y >= zy - 400 AND y < zy + 400 LEFT JOIN s ON s.c_custkey = p.c_custkey GROUP BY zone")
def q_zone_table(spark, d):
    p, z = zone_inputs(spark, d)
    units = t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 1.0).cast("double").alias("v"))
    r = analysis.zone_table(units, p.select("c_custkey", F.col("y").alias("lat"), F.col("x").alias("lon")), z, "c_custkey", "zone", "ring", "v", 500.0)
    return r.withColumn("mean", rnd("mean")).withColumn("std", rnd("std"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 5 = 0) AS n_unparsed, count(*) FILTER (WHERE event_id % 3 = 0) AS n_truncated, count(*) FILTER (WHERE event_id % 15 = 0) AS n_repaired, round(avg((event_id % 5 <> 0)::INT), 6) AS parse_rate FROM events GROUP BY 1")
def q_answer_stats(spark, d):
    k = F.col("event_id")
    e = t(spark, d, "events").select("event_type", (k % 5 != 0).alias("p"), (k % 3 == 0).alias("c"), (k % 15 == 0).alias("r"))
    return analysis.answer_stats(e, ["event_type"], "p", "c", "r").withColumn("parse_rate", rnd("parse_rate"))


@query("""
WITH p AS (SELECT o_custkey, date_trunc('day', o_orderdate) AS i, date_trunc('day', o_orderdate) + to_days((200 + o_orderkey % 900)::INTEGER) AS e, CASE WHEN o_orderkey % 4 = 0 THEN date_trunc('day', o_orderdate) + INTERVAL 30 DAY END AS c FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY i DESC, e DESC NULLS LAST) AS rn FROM p) WHERE rn = 1), s AS (SELECT c_custkey, i, CASE WHEN i IS NULL THEN 'none' WHEN c <= TIMESTAMP '1998-06-01' THEN 'closed' WHEN e < TIMESTAMP '1998-06-01' THEN 'expired' ELSE 'active' END AS state FROM customer LEFT JOIN l ON o_custkey = c_custkey)
SELECT c_custkey, state, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_permits, CASE WHEN state IN ('active', 'expired') THEN date_diff('day', i, TIMESTAMP '1998-06-01') END::INTEGER AS days_open FROM s""")
def q_permit_lifecycle(spark, d):
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    p = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), day.alias("issued"), F.date_add(day, (200 + k % 900).cast("int")).alias("expires"), F.when(k % 4 == 0, F.date_add(day, 30)).alias("closed"))
    return analysis.permit_lifecycle(p, t(spark, d, "customer").select("c_custkey"), "c_custkey", "issued", "expires", "closed", F.to_date(F.lit("1998-06-01"))).select("c_custkey", "state", "n_permits", "days_open")


@query("""
WITH f AS (SELECT s_acctbal AS x, s_nationkey * 40.0 AS y, s_suppkey AS filed FROM supplier), u AS (SELECT c_custkey, c_acctbal AS ux, (c_custkey % 25) * 40.0 AS uy, c_custkey % 2 = 0 AS seen FROM customer),
j AS (SELECT c_custkey, count(*) AS n, max(filed) AS last FROM u JOIN f ON x >= ux - 50 AND x < ux + 50 AND y >= uy - 50 AND y < uy + 50 GROUP BY 1)
SELECT u.c_custkey, seen, last AS last_filed, coalesce(n, 0) AS n_filed, CASE WHEN seen AND n IS NOT NULL THEN 'covered' WHEN seen THEN 'unpermitted' WHEN n IS NOT NULL THEN 'unseen' ELSE 'clear' END AS status FROM u LEFT JOIN j USING (c_custkey)""")
def q_compliance(spark, d):
    f = t(spark, d, "supplier").select(F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 40.0).alias("y"), F.col("s_suppkey").alias("filed"))
    c = t(spark, d, "customer")
    buffers = c.select("c_custkey", square(F.col("c_acctbal"), (F.col("c_custkey") % 25) * 40.0, 50.0).alias("ring"))
    return analysis.compliance(c.select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("seen")), f, buffers, "c_custkey", "ring", "filed", 100.0).select("c_custkey", "seen", "last_filed", "n_filed", "status")


LAYERS = "WITH a AS (SELECT c_nationkey AS zone, avg(c_acctbal) AS income FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1), b AS (SELECT s_nationkey AS zone, sum(s_acctbal) AS crime FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY 1), j AS (SELECT n_nationkey AS zone, n_regionkey, income, crime FROM nation LEFT JOIN (SELECT zone, income, crime FROM a FULL JOIN b USING (zone)) l ON l.zone = n_nationkey)"


def layers(spark, d):
    a = t(spark, d, "customer").where("c_nationkey % 6 <> 0").groupBy(F.col("c_nationkey").alias("zone")).agg(F.avg("c_acctbal").alias("v"))
    b = t(spark, d, "supplier").where("s_nationkey % 5 <> 0").groupBy(F.col("s_nationkey").alias("zone")).agg(F.sum("s_acctbal").alias("v"))
    return analysis.layer_table({"income": a, "crime": b}, "zone", t(spark, d, "nation").withColumnRenamed("n_nationkey", "zone"))


@query(LAYERS + " SELECT zone, round(income, 4) AS income, round(crime, 4) AS crime, ((income IS NOT NULL)::INTEGER + (crime IS NOT NULL)::INTEGER) AS n_layers FROM j")
def q_layer_table(spark, d):
    return layers(spark, d).select("zone", rnd("income", 4).alias("income"), rnd("crime", 4).alias("crime"), "n_layers")


@query("""
WITH f AS (SELECT count(*) AS n, regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a, regr_r2(o_totalprice, o_custkey) AS r2, avg(o_custkey) AS mx, regr_sxx(o_totalprice, o_custkey) AS sxx, corr(o_totalprice, o_custkey) AS beta FROM orders),
h AS (SELECT sum(power((o_custkey - mx) * (o_totalprice - a - b * o_custkey) / (1 - 1.0 / n - power(o_custkey - mx, 2) / sxx), 2)) / power(max(sxx), 2) AS v FROM orders, f)
SELECT 'price' AS spec, 'o_custkey' AS regressor, n, round(b, 4) AS coef, round(sqrt(v), 4) AS se_hc3, round(b / sqrt(v), 4) AS t, round(beta, 6) AS beta, round(r2, 6) AS partial_r2, round(r2, 6) AS r2 FROM f, h""")
def q_regressions(spark, d):
    r = analysis.regressions(t(spark, d, "orders"), {"price": ("o_totalprice", ["o_custkey"])})
    return r.select("spec", "regressor", "n", *[rnd(c, 4).alias(c) for c in ("coef", "se_hc3", "t")], *[rnd(c).alias(c) for c in ("beta", "partial_r2", "r2")])


@query("SELECT o_orderpriority, min(n) AS n, round(max(m) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"mean_F\", round(max(x) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"top_F\", round(max(m) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"mean_O\", round(max(x) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"top_O\" FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m, max(o_totalprice) AS x FROM orders GROUP BY ALL) JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) USING (o_orderpriority) GROUP BY 1")
def q_results_table(spark, d):
    o = t(spark, d, "orders")
    cells = o.groupBy("o_orderpriority", "o_orderstatus").agg(rnd(F.avg("o_totalprice"), 4).alias("mean"), rnd(F.max("o_totalprice"), 4).alias("top")).join(o.groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority")
    return analysis.results_table(cells, ["o_orderpriority"], "o_orderstatus", ["F", "O"], ["mean", "top"], ["n"])


@query("SELECT event_type, max('run_' || lpad(event_id::VARCHAR, 9, '0') || '.parquet') AS path FROM events GROUP BY 1")
def q_newest_by_name(spark, d):
    e = t(spark, d, "events").select("event_type", F.concat(F.lit("run_"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".parquet")).alias("path"))
    return analysis.newest_by_name(e, "path", ["event_type"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS expected, CASE WHEN c_custkey % 3 = 0 THEN 'label' WHEN c_custkey % 4 = 0 THEN 'answer' END AS expected_source FROM customer""")
def q_merge_expected(spark, d):
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    refs = c.where("c_custkey % 5 <> 4 or c_custkey % 3 = 0 or c_custkey % 4 = 0").select("c_custkey", F.when(k % 3 == 0, F.col("c_name")).alias("label"), F.when(k % 4 == 0, F.col("c_mktsegment")).alias("answer"))
    return analysis.merge_expected(c.select("c_custkey"), refs, ["c_custkey"], ["absent", "label", "answer"])


@query("""
WITH l AS (SELECT user_id, event_id % 50 AS layer, max(value) AS v FROM events GROUP BY ALL) SELECT user_id, layer, min(layer) FILTER (WHERE v >= 60) OVER w AS first_layer, round(max(v) OVER w, 4) AS peak, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, layer)::INTEGER AS rank FROM l WINDOW w AS (PARTITION BY user_id)""")
def q_group_results(spark, d):
    e = t(spark, d, "events").groupBy("user_id", (F.col("event_id") % 50).alias("layer")).agg(F.max("value").alias("v"))
    return analysis.with_group_results(e, ["user_id"], "layer", "v", 60).select("user_id", "layer", "first_layer", rnd("peak", 4).alias("peak"), "rank")


@query("""
WITH e AS (SELECT event_id % 8 AS layer, event_type AS tok, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value - 30 END AS v FROM events), c AS (SELECT layer, tok, count(*) AS c FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY c DESC, tok) AS rn FROM c)
SELECT e.layer, e.n, e.mean, e.share_positive, string_agg(r.tok, '|' ORDER BY r.rn) AS top_tokens FROM (SELECT layer, count(*) AS n, round(avg(v), 6) AS mean, round(avg((v > 0)::INT), 6) AS share_positive FROM e GROUP BY 1) e JOIN r ON r.layer = e.layer AND r.rn <= 2 GROUP BY ALL""")
def q_layer_summary(spark, d):
    e = t(spark, d, "events").select((F.col("event_id") % 8).alias("layer"), F.col("event_type").alias("tok"), F.when(F.col("event_id") % 6 == 0, float("nan")).otherwise(F.col("value") - 30).alias("v"))
    return analysis.layer_summary(e, [], "layer", "v", "tok", 2).withColumn("mean", rnd("mean")).withColumn("share_positive", rnd("share_positive"))


@query("SELECT event_id % 12 AS layer, count(*) AS n, round(avg((event_type = last)::INT), 6) AS agreement FROM events JOIN (SELECT user_id, max_by(event_type, event_id) AS last FROM events GROUP BY 1) USING (user_id) GROUP BY 1")
def q_layer_agreement(spark, d):
    e = t(spark, d, "events")
    final = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("final"))
    x = e.join(final, "user_id").withColumn("layer", F.col("event_id") % 12)
    return analysis.layer_agreement(x, ["user_id"], "layer", "event_type", "final").withColumn("agreement", rnd("agreement"))


@query("SELECT s_nationkey, count(*)::INTEGER AS n_rings, round(min(s_acctbal) - 5, 6) AS x0, round(max(s_acctbal) + 5, 6) AS x1, min(s_suppkey) - 5.0::DOUBLE AS y0, max(s_suppkey) + 5.0::DOUBLE AS y1 FROM supplier GROUP BY 1")
def q_dissolved(spark, d):
    s = t(spark, d, "supplier").select("s_nationkey", square(F.col("s_acctbal"), F.col("s_suppkey"), 5.0).alias("ring"))
    return analysis.dissolved(s, "s_nationkey", "ring").select("s_nationkey", F.size("rings").alias("n_rings"), rnd("x0").alias("x0"), rnd("x1").alias("x1"), "y0", "y1")


@query("SELECT n_name AS iso, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4 GROUP BY ALL")
def q_by_first_key(spark, d):
    k = F.col("n_nationkey")
    shapes = t(spark, d, "nation").select("n_nationkey", F.when(k % 3 == 0, "-99").when(k % 5 == 4, "").otherwise(F.col("n_name")).alias("iso_a3"), F.when((k % 3 == 0) & (k % 5 != 4), F.col("n_name")).otherwise(" ").alias("adm0"))
    stats = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("iso")).agg(F.count("*").alias("n"))
    return analysis.by_first_key(stats, shapes, "iso", ["iso_a3", "adm0"]).select("iso", "n_nationkey", "n")


@query("SELECT e AS epoch, count(*) AS n, count(DISTINCT c_custkey) AS n_ids, true AS in_range FROM customer, (VALUES (0), (1), (2)) v(e) GROUP BY e")
def q_minibatches(spark, d):
    c = t(spark, d, "customer")
    last = -(-c.count() // 64) - 1
    b = analysis.minibatches(c, "c_custkey", 64, 3, 1)
    return b.groupBy("epoch").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("n_ids"), F.bool_and(F.col("batch").between(0, last)).alias("in_range"))


@query("SELECT 'orders' AS stage, count(*) AS n FROM orders UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def q_save_stages(spark, d):
    e = t(spark, d, "embeddings")
    paths = analysis.save_stages({"orders": t(spark, d, "orders"), "vectors": e.select("vec_id", F.struct("embedding", "label").alias("nested"))}, scratch(spark, "stages"))
    one = lambda name: spark.read.parquet(paths[name]).agg(F.lit(name).alias("stage"), F.count("*").alias("n"))
    return one("orders").unionByName(one("vectors"))


@query("SELECT conv_id, turn, i::INTEGER AS span_index, CASE i WHEN 0 THEN role WHEN 1 THEN 'len' END AS extraction_class FROM conversations JOIN (VALUES (0), (1)) v(i) ON i < turn % 3 UNION ALL SELECT conv_id, turn, NULL, NULL FROM conversations WHERE turn % 3 = 0")
def q_annotations(spark, d):
    span = lambda c: F.struct(c.alias("class"), F.col("text"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    c = t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.slice(F.array(span(F.col("role")), span(F.lit("len"))), F.lit(1), (F.col("turn") % 3).cast("int")).alias("spans"))
    return analysis.annotations_to_rows(c, "k", "spans").select("k.conv_id", "k.turn", "span_index", "extraction_class")


BINS = "WITH b AS (SELECT DISTINCT s_suppkey % 12 AS edge, floor((s_suppkey % 100) / 10.0) AS bin FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY bin) AS i, count(*) OVER (PARTITION BY edge) AS n FROM b)"


@query(BINS + " SELECT edge::BIGINT AS edge, bin::BIGINT AS bin FROM b")
def q_edge_bins(spark, d):
    points, edges = edge_inputs(spark, d)
    return analysis.edge_bins(points, edges, "s_suppkey", "edge", 10.0, 3).select("edge", "bin")


@query(BINS + """, l AS (SELECT a.edge || ':' || a.bin::BIGINT AS src, b.edge || ':' || b.bin::BIGINT AS dst FROM o a JOIN o b ON a.edge = b.edge AND b.i = a.i + 1),
tips AS (SELECT edge % 4 AS node, edge || ':' || bin::BIGINT AS tip, edge FROM o WHERE i = 1 UNION ALL SELECT 100 + edge % 3, edge || ':' || bin::BIGINT, edge FROM o WHERE i = n),
x AS (SELECT a.tip AS src, b.tip AS dst FROM tips a JOIN tips b ON a.node = b.node AND a.edge < b.edge), u AS (SELECT * FROM l UNION ALL SELECT * FROM x)
SELECT src, dst FROM u UNION SELECT dst, src FROM u""")
def q_edge_chain(spark, d):
    points, edges = edge_inputs(spark, d)
    bins = analysis.edge_bins(points, edges, "s_suppkey", "edge", 10.0, 3).withColumn("name", F.concat_ws(":", F.col("edge").cast("string"), F.col("bin").cast("string")))
    return analysis.edge_chain(bins, edges, "name", "edge")


def edge_inputs(spark, d):
    s = F.col("s_suppkey")
    points = t(spark, d, "supplier").select("s_suppkey", (s % 12).alias("edge"), (s % 100).cast("double").alias("x"), F.lit(3.0).alias("y"))
    edges = spark.range(12).select(F.col("id").alias("edge"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1000.0).alias("bx"), F.lit(0.0).alias("by"), (F.col("id") % 4).alias("from_node"), (100 + F.col("id") % 3).alias("to_node"))
    return points, edges
