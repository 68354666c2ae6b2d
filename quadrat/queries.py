"""Named queries over the shared tables: each applies operators, beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat import queries_analysis, queries_curation, queries_jobs  # noqa: F401  they register their own
from quadrat.functions import boxes, columns, geo, nested, text
from quadrat.operators import graph, judgments, models, reports, rows, sampling, spans, spatial, timeline, vectors
from quadrat.plans import validation
from quadrat.registry import ORACLE_SQL, QUERIES, query, rnd, t  # noqa: F401
from quadrat.streaming import events as streams


@query("""
WITH g AS (SELECT user_id, event_type, count(*) AS n_events, round(avg(value), 6) AS mean_value, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS n_high, min(ts) AS first_ts FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS rn FROM g)
SELECT user_id, event_type, n_events, mean_value, n_high, n_high > 0 AS has_high, year(first_ts)::INTEGER AS year, month(first_ts)::INTEGER AS month FROM r WHERE rn = 1""")
def q_index_first_dataset(spark, d):
    g = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n_events"), rnd(F.avg("value")).alias("mean_value"), F.count_if(F.col("value") > 50).alias("n_high"), F.min("ts").alias("first_ts"))
    one = rows.first_per(g, ["user_id"], F.col("event_type"))
    return one.select("user_id", "event_type", "n_events", "mean_value", "n_high", (F.col("n_high") > 0).alias("has_high"), F.year("first_ts").alias("year"), F.month("first_ts").alias("month"))


@query("SELECT round((floor(c_acctbal / 500) + 0.5) * 500, 6) AS lat, round((floor(c_custkey / 100) + 0.5) * 500, 6) AS lon, count(*) AS n, min(c_name) AS sample_id FROM customer GROUP BY ALL")
def q_overview_grid(spark, d):
    c = t(spark, d, "customer").withColumn("x", F.col("c_custkey") * 5.0)
    return spatial.overview_grid(c, "c_acctbal", "x", 500.0, "c_name").select(rnd("lat").alias("lat"), rnd("lon").alias("lon"), "n", "sample_id")


@query("""SELECT s_suppkey, round(dist_m, 3) AS dist_m FROM (SELECT s_suppkey, sqrt(power((s_acctbal/100000 - 0.03) * cos(radians(0.05)) * 111320, 2) + power((s_suppkey/1000.0 - 0.05) * 111320, 2)) AS dist_m, s_suppkey/1000.0 AS la, s_acctbal/100000 AS lo FROM supplier) WHERE dist_m <= 9000 ORDER BY dist_m, s_suppkey LIMIT 10""")
def q_nearest_topk(spark, d):
    s = t(spark, d, "supplier").withColumn("lat", F.col("s_suppkey") / 1000.0).withColumn("lon", F.col("s_acctbal") / 100000)
    return spatial.nearest_to(s, 0.05, 0.03, 10, 9000.0, tie=["s_suppkey"]).select("s_suppkey", rnd("dist_m", 3).alias("dist_m"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderkey BETWEEN 100 AND 50000 AND o_orderstatus = 'O'")
def q_bbox_count(spark, d):
    from quadrat.sources.readers import in_box, query_catalog

    boxed = in_box(t(spark, d, "orders"), "o_totalprice", "o_orderkey", (200000, 100), (100000, 50000))
    return query_catalog(boxed, where="o_orderstatus = 'O'").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, round(l_extendedprice, 4) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def q_collapse_most_critical(spark, d):
    crit = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return rows.first_per(t(spark, d, "lineitem"), ["l_orderkey"], crit, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_returnflag", rnd("l_extendedprice", 4).alias("price"))


@query("""
WITH s AS (SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 50000) AS n_real, count(*) FILTER (WHERE NOT o_totalprice > 50000) AS n_placeholder, min(o_orderdate) FILTER (WHERE o_totalprice > 50000) AS first_date, max(o_orderdate) FILTER (WHERE o_totalprice > 50000) AS last_date,
 count(*) FILTER (WHERE o_totalprice > 50000 AND o_orderstatus = 'O') AS n_grade_o, count(*) FILTER (WHERE o_totalprice > 50000 AND o_orderstatus = 'F') AS n_grade_f, count(*) FILTER (WHERE o_totalprice > 50000 AND o_orderstatus NOT IN ('O', 'F')) AS n_grade_other FROM orders GROUP BY o_custkey),
h AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 50000 THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderpriority, n_real, n_placeholder, first_date, last_date, n_grade_o, n_grade_f, n_grade_other FROM h JOIN s USING (o_custkey) WHERE rn = 1""")
def q_entity_rollup(spark, d):
    real = F.col("o_totalprice") > 50000
    r = rows.entity_rollup(t(spark, d, "orders"), "o_custkey", [F.when(real, 0).otherwise(1), F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")], real, "o_orderdate", "o_orderstatus", ("O", "F"))
    return r.select("o_custkey", "o_orderkey", "o_orderpriority", "n_real", "n_placeholder", "first_date", "last_date", "n_grade_o", "n_grade_f", "n_grade_other")


@query("SELECT c_custkey, o.o_custkey IS NOT NULL AS hit, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def q_left_join_hit_flag(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return rows.hit_join(t(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "hit").select("c_custkey", "hit", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""
WITH e AS (SELECT c_custkey, min(o_orderkey) AS v FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1),
f AS (SELECT c_custkey, min(o_orderkey) AS v FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c.c_custkey, coalesce(e.v, f.v) AS v, CASE WHEN e.v IS NOT NULL THEN 'large' WHEN f.v IS NOT NULL THEN 'any' ELSE 'none' END AS v_source FROM customer c LEFT JOIN e USING (c_custkey) LEFT JOIN f USING (c_custkey)""")
def q_cascade_join(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    least = lambda x: x.groupBy("c_custkey").agg(F.min("o_orderkey").alias("v"))
    return rows.cascade_join(t(spark, d, "customer").select("c_custkey"), "c_custkey", [("large", least(o.where("o_totalprice > 300000"))), ("any", least(o))], "v")


@query("""
WITH pts AS (SELECT s_suppkey AS k, s_acctbal AS x, s_nationkey * 100.0 AS y FROM supplier), tgt AS (SELECT c_custkey AS c, c_acctbal AS tx, c_nationkey * 100.0 AS ty FROM customer),
j AS (SELECT k, c, sqrt(power(x - tx, 2) + power(y - ty, 2)) AS dd FROM pts JOIN tgt ON abs(x - tx) <= 60 AND abs(y - ty) <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dd, c) AS rank FROM j WHERE dd <= 60)
SELECT k, c, round(dd, 6) AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def q_nearest_within(spark, d):
    p = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    return spatial.nearest(p, c, "k", "c", 60.0, k=3).select("k", "c", rnd("dist").alias("dist"), "rank")


@query("SELECT c_custkey, 'none' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'large' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def q_semi_anti_sets(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("none")).unionByName(c.join(o.where("o_totalprice > 400000"), "c_custkey", "left_semi").withColumn("kind", F.lit("large")))


@query("SELECT l_partkey FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) GROUP BY l_partkey HAVING count(*) = 3")
def q_common_ids(spark, d):
    x = t(spark, d, "lineitem")
    return rows.common_ids({f: x.where(F.col("l_returnflag") == f) for f in ("A", "N", "R")}, "l_partkey")


@query("SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier")
def q_union_relaxed(spark, d):
    c = t(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return rows.typed(rows.union_relaxed(c, s), "source string, id long, name string, nation int, balance double, segment string")


@query("SELECT p_partkey, CASE WHEN n > 1 THEN base || '_' || (rn - 1) ELSE base END AS uid FROM (SELECT p_partkey, p_brand || '-' || p_size AS base, count(*) OVER (PARTITION BY p_brand, p_size) AS n, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS rn FROM part)")
def q_collision_uid(spark, d):
    p = t(spark, d, "part").withColumn("base", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    return rows.occurrence_suffix(p, "base", [F.col("p_partkey")]).select("p_partkey", "uid")


@query("""
WITH s AS (SELECT 'p' || (l_partkey % 50) AS unit, l_quantity - 25 AS v FROM lineitem UNION ALL SELECT 'p' || (l_suppkey % 50), -(l_quantity - 25) FROM lineitem)
SELECT unit, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, 0.0::DOUBLE AS abstention_rate FROM s GROUP BY unit HAVING count(*) >= 10""")
def q_both_sides_unpivot(spark, d):
    x = t(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("unit_a"), F.concat(F.lit("p"), F.col("l_suppkey") % 50).alias("unit_b"), (F.col("l_quantity") - 25).alias("score"))
    return judgments.score_units(x, "unit", "score", 10).select("unit", "n", rnd("mean").alias("mean"), rnd("std").alias("std"), "abstention_rate")


@query("""
WITH c AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1), dim AS (SELECT * FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, 'other')) v(position, label))
SELECT position::INTEGER AS position, label, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS share FROM dim LEFT JOIN c USING (label)""")
def q_label_distribution(spark, d):
    return judgments.label_distribution(t(spark, d, "orders"), "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM")).select("position", "label", "n", rnd("share").alias("share"))


@query("""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS c, count(*) FILTER (WHERE o_totalprice < 1000) AS m FROM orders GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY o_orderstatus) AS tot FROM c)
SELECT o_orderstatus, sum(c)::BIGINT AS n, round(sum(m) / sum(c), 6) AS missing_rate, count(*) AS n_labels, round(max(c) / sum(c), 6) AS majority_share, round(-sum(c / tot * ln(c / tot)), 6) AS entropy FROM s GROUP BY o_orderstatus""")
def q_label_entropy(spark, d):
    r = judgments.label_diagnostics(t(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice") < 1000, ["o_orderstatus"])
    return r.select("o_orderstatus", "n", rnd("missing_rate").alias("missing_rate"), "n_labels", rnd("majority_share").alias("majority_share"), rnd("entropy").alias("entropy"))


@query("SELECT o_orderstatus, round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 6) AS urgent, round(count(*) FILTER (WHERE o_orderpriority = '5-LOW') / count(*), 6) AS low, count(*) AS n FROM orders GROUP BY 1")
def q_position_bias(spark, d):
    r = judgments.position_bias(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ("1-URGENT", "5-LOW"))
    return r.select("o_orderstatus", rnd("1-URGENT").alias("urgent"), rnd("5-LOW").alias("low"), "n")


@query("""
WITH s AS (SELECT user_id, event_type, floor(value / 20)::BIGINT - 2 AS sc FROM events), g AS (SELECT count(*) AS k, count(DISTINCT sc) = 1 AS ex, count(DISTINCT sign(sc)) = 1 AS sg, var_pop(sc) AS v, max(sc) - min(sc) AS sp FROM s GROUP BY user_id, event_type HAVING count(*) >= 2)
SELECT count(*) AS n_groups, round(avg(ex::INT), 6) AS exact_rate, round(avg(sg::INT), 6) AS sign_rate, round(avg(v), 6) AS mean_variance, round(avg(sp), 6) AS mean_span FROM g""")
def q_repeat_consistency(spark, d):
    e = t(spark, d, "events").withColumn("sc", F.floor(F.col("value") / 20) - 2)
    r = judgments.repeat_consistency(e, ["user_id", "event_type"], "sc")
    return r.select("n_groups", *[rnd(c).alias(c) for c in ("exact_rate", "sign_rate", "mean_variance", "mean_span")])


@query("SELECT o_custkey, round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"F\", round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"O\", round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS \"P\" FROM orders GROUP BY 1")
def q_pivot_models(spark, d):
    best = t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(rnd(F.max("o_totalprice"), 4).alias("v"))
    return rows.pivot_first(best, "o_custkey", "o_orderstatus", "v", ["F", "O", "P"])


@query("SELECT o_custkey, round(var_pop(o_totalprice), 2) AS variance, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2 ORDER BY var_pop(o_totalprice) DESC, o_custkey LIMIT 20")
def q_high_variance(spark, d):
    return judgments.high_variance(t(spark, d, "orders"), "o_custkey", "o_totalprice", 20).select("o_custkey", rnd("variance", 2).alias("variance"), "n")


@query("""
WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), tot AS (SELECT sum(n) AS t FROM c), ma AS (SELECT a, sum(n) AS na FROM c GROUP BY a), mb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b)
SELECT t::BIGINT AS n, round((SELECT sum(n) FROM c WHERE a = b) / t, 6) AS agreement, round(1 - (SELECT sum(power(a - b, 2) * n) FROM c) * t / (SELECT sum(power(a - b, 2) * na * nb) FROM ma, mb), 6) AS kappa FROM tot""")
def q_kappa_confusion(spark, d):
    return judgments.kappa(t(spark, d, "labels"), "quality", "toxic", "quadratic").select(F.col("n").cast("long").alias("n"), rnd("agreement").alias("agreement"), rnd("kappa").alias("kappa"))


@query("""
WITH u AS (SELECT o_custkey, count(*) AS m, sum(s) AS s, sum(s * s) AS q FROM (SELECT o_custkey, substr(o_orderpriority, 1, 1)::DOUBLE AS s FROM orders) GROUP BY 1 HAVING count(*) >= 2)
SELECT sum(m)::BIGINT AS n, round(1 - (sum(2 * (m * q - s * s) / (m - 1)) / sum(m)) / (2 * (sum(m) * sum(q) - sum(s) * sum(s)) / (sum(m) * (sum(m) - 1))), 6) AS alpha FROM u""")
def q_krippendorff(spark, d):
    o = t(spark, d, "orders").withColumn("s", F.substring("o_orderpriority", 1, 1).cast("double"))
    return judgments.krippendorff_alpha(o, "o_custkey", "s").select("n", rnd("alpha").alias("alpha"))


@query("""
WITH z AS (SELECT c_nationkey, c_mktsegment, (c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey))
SELECT c_mktsegment, round(avg(z), 6) AS mean_z, round(stddev_pop(z), 6) AS std_z, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, count(*) AS n_models FROM z GROUP BY 1""")
def q_zscore_ensemble(spark, d):
    r = judgments.zscore_ensemble(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return r.select("c_mktsegment", *[rnd(c).alias(c) for c in ("mean_z", "std_z", "min_z", "max_z")], "n_models")


HEAD = "SELECT o_custkey AS canonical_pair_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * (o_totalprice - 150000) AS x FROM orders WHERE o_orderstatus IN ('F', 'O')"


@query(f"""
WITH p AS (SELECT canonical_pair_id, avg(x) AS x, count(*) AS k FROM ({HEAD}) GROUP BY 1), m AS (SELECT sum(k)::BIGINT AS n_obs, count(*) AS n_pairs, avg(x) AS mean, stddev_samp(x) AS sd, count(*) FILTER (WHERE x > 0) AS wins, count(*) FILTER (WHERE x < 0) AS losses FROM p)
SELECT n_obs, n_pairs, round(mean, 4) AS mean, round(sd / sqrt(n_pairs), 4) AS se, round(mean / (sd / sqrt(n_pairs)), 6) AS t, wins, losses, round(wins / (wins + losses), 6) AS win_rate, round(mean / sd, 6) AS cohens_d FROM m""")
def q_head_to_head(spark, d):
    o = t(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_custkey").alias("canonical_pair_id"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("group_a"), F.when(F.col("o_orderstatus") == "F", "b").otherwise("a").alias("group_b"), (F.col("o_totalprice") - 150000).alias("relative_score"))
    r = judgments.head_to_head(o, "a", "b")
    return r.select("n_obs", "n_pairs", rnd("mean", 4).alias("mean"), rnd("se", 4).alias("se"), rnd("t").alias("t"), "wins", "losses", rnd("win_rate").alias("win_rate"), rnd("cohens_d").alias("cohens_d"))


@query("""
WITH x AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM x),
m AS (SELECT count(*) FILTER (WHERE g = 'BUILDING') AS n_a, count(*) FILTER (WHERE g = 'MACHINERY') AS n_b, avg(v) FILTER (WHERE g = 'BUILDING') AS ma, avg(v) FILTER (WHERE g = 'MACHINERY') AS mb, var_samp(v) FILTER (WHERE g = 'BUILDING') AS va, var_samp(v) FILTER (WHERE g = 'MACHINERY') AS vb, sum(rk) FILTER (WHERE g = 'BUILDING') AS ra FROM r)
SELECT n_a, n_b, round(ma - mb, 6) AS delta, round((ma - mb) / sqrt(va / n_a + vb / n_b), 6) AS welch_t, round(ra - n_a * (n_a + 1) / 2, 4) AS mann_whitney_u, round(2 * (ra - n_a * (n_a + 1) / 2) / (n_a * n_b) - 1, 6) AS cliffs_delta FROM m""")
def q_welch(spark, d):
    r = judgments.rating_level(t(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return r.select("n_a", "n_b", rnd("delta").alias("delta"), rnd("welch_t").alias("welch_t"), rnd("mann_whitney_u", 4).alias("mann_whitney_u"), rnd("cliffs_delta").alias("cliffs_delta"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, ((p_partkey * 7919) % 10007) / 10007.0 AS p FROM part), r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p) AS raw FROM p)
SELECT p_partkey, round(least(1.0, min(raw) OVER (PARTITION BY p_brand ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def q_bh_adjust(spark, d):
    p = t(spark, d, "part").withColumn("p", (F.col("p_partkey") * 7919 % 10007) / 10007.0)
    return judgments.benjamini_hochberg(p, "p", "q", ["p_brand"]).select("p_partkey", rnd("q", 9).alias("q"))


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_extendedprice, l_quantity), 6) AS corr FROM lineitem GROUP BY 1")
def q_ols_simple(spark, d):
    return models.simple_ols(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", "n", rnd("slope", 4).alias("slope"), rnd("intercept", 4).alias("intercept"), rnd("r2").alias("r2"), rnd("corr").alias("corr"))


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r""")
def q_spearman(spark, d):
    return models.spearman(t(spark, d, "lineitem"), "l_quantity", "l_discount").select("n", rnd("spearman").alias("spearman"))


@query("""
WITH f AS (SELECT count(*) AS n, regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a, avg(o_custkey) AS mx, regr_sxx(o_totalprice, o_custkey) AS sxx, regr_syy(o_totalprice, o_custkey) - power(regr_sxy(o_totalprice, o_custkey), 2) / regr_sxx(o_totalprice, o_custkey) AS rss FROM orders),
c AS (SELECT o_orderkey, power(o_totalprice - a - b * o_custkey, 2) / (2 * rss / (n - 2)) * (1.0 / n + power(o_custkey - mx, 2) / sxx) / power(1 - (1.0 / n + power(o_custkey - mx, 2) / sxx), 2) AS d FROM orders, f)
SELECT o_orderkey, round(d, 9) AS cooks_d FROM c ORDER BY d DESC, o_orderkey LIMIT 10""")
def q_cook(spark, d):
    return models.cooks_distance(t(spark, d, "orders"), "o_totalprice", "o_custkey", 10, "o_orderkey").select("o_orderkey", rnd("cooks_d", 9).alias("cooks_d"))


@query("""
WITH e AS (SELECT quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM orders), b AS (SELECT o_totalprice, CASE WHEN o_totalprice <= e[2] THEN 0 WHEN o_totalprice <= e[3] THEN 1 WHEN o_totalprice <= e[4] THEN 2 WHEN o_totalprice <= e[5] THEN 3 ELSE 4 END AS band FROM orders, e)
SELECT band::INTEGER AS band, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM b GROUP BY band""")
def q_qcut_bands(spark, d):
    return models.quantile_bands(t(spark, d, "orders"), "o_totalprice", 5).groupBy("band").agg(F.count("*").alias("n"), rnd(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT s_nationkey, round(coalesce(sum(s_acctbal * w) / nullif(sum(w), 0), avg(s_acctbal)), 6) AS mean FROM (SELECT *, CASE WHEN s_nationkey % 5 = 0 THEN 0.0 ELSE s_suppkey % 7 END AS w FROM supplier) GROUP BY 1")
def q_weighted_mean_fallback(spark, d):
    s = t(spark, d, "supplier").withColumn("w", F.when(F.col("s_nationkey") % 5 == 0, 0.0).otherwise(F.col("s_suppkey") % 7))
    return s.groupBy("s_nationkey").agg(rnd(models.weighted_mean(F.col("s_acctbal"), F.col("w"))).alias("mean"))


@query("SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q_crosstab_margins(spark, d):
    return rows.crosstab(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("WITH y AS (SELECT o_orderstatus, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, y, n, lag(n) OVER w AS previous, round((n - lag(n) OVER w) / lag(n) OVER w, 6) AS growth FROM y WINDOW w AS (PARTITION BY o_orderstatus ORDER BY y)")
def q_period_growth(spark, d):
    g = t(spark, d, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return rows.period_growth(g, ["o_orderstatus"], "y", "n").withColumn("growth", rnd("growth"))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def q_running_total(spark, d):
    return timeline.running_total(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", rnd("total", 4).alias("total"))


@query("""
WITH j AS (SELECT event_type AS kind, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + 600 + (event_id % 50) * 60 AS e FROM events), g AS (SELECT kind, 1704067200 + (i + 0.5) * 21600 AS t FROM (SELECT DISTINCT kind FROM j), range(40) r(i))
SELECT g.kind, CAST(round(g.t, 1) AS DOUBLE) AS t, count(j.s) AS busy FROM g LEFT JOIN j ON j.kind = g.kind AND greatest(j.s, 1704067200) <= g.t AND least(j.e, 1704067200 + 864000) > g.t AND least(j.e, 1704067200 + 864000) > greatest(j.s, 1704067200) GROUP BY ALL""")
def q_occupancy_sweep(spark, d):

    e = t(spark, d, "events").select(F.col("event_type").alias("kind"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("s"), F.lit(1).alias("n"), "event_id").withColumn("e", F.col("s") + 600 + (F.col("event_id") % 50) * 60)
    return timeline.occupancy(e, "kind", "s", "e", "n", 1704067200, 1704067200 + 864000, 21600).select("kind", F.round(F.col("t").cast("double"), 1).alias("t"), "busy")


@query("""
WITH b AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600000000 THEN 1 ELSE 0 END AS nw FROM events)
SELECT event_id, user_id, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM b""")
def q_sessionize(spark, d):
    return timeline.gap_sessions(t(spark, d, "events"), ["user_id"], "ts", 21600, ["event_id"]).select("event_id", "user_id", "session")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def q_latest_per_key(spark, d):
    o = t(spark, d, "orders").withColumn("_o", F.struct("o_orderdate", "o_orderkey"))
    return rows.latest_record(o, "o_custkey", "_o").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT p_brand, p_partkey, round(p_retailprice, 4) AS price FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def q_topn_per_group(spark, d):
    return rows.first_per(t(spark, d, "part"), ["p_brand"], F.desc("p_retailprice"), F.col("p_partkey"), n=3).select("p_brand", "p_partkey", rnd("p_retailprice", 4).alias("price"))


@query("SELECT c_custkey, (CAST('0x' || substr(sha256(c_custkey || '|7'), 1, 8) AS BIGINT) % 5)::INTEGER AS bucket, ['MuchLess', 'Less', 'Same', 'More', 'MuchMore'][1 + CAST('0x' || substr(sha256(c_custkey || '|7'), 1, 8) AS BIGINT) % 5] AS label FROM customer")
def q_debug_label(spark, d):
    return t(spark, d, "customer").select("c_custkey", columns.hash_bucket(F.col("c_custkey"), 7, 5).alias("bucket"), judgments.debug_label(F.col("c_custkey"), 7).alias("label"))


@query("WITH f AS (SELECT o_custkey, dense_rank() OVER (ORDER BY mo, o_custkey) - 1 AS i FROM (SELECT o_custkey, min(o_orderkey) AS mo FROM orders GROUP BY 1)) SELECT o_orderkey, (i % 7)::INTEGER AS shard FROM orders JOIN f USING (o_custkey)")
def q_stride_shard(spark, d):
    return sampling.stride_shards(t(spark, d, "orders"), "o_custkey", "o_orderkey", 7).select("o_orderkey", "shard")


@query("WITH w AS (SELECT source, unnest(regexp_extract_all(regexp_replace(lower(text), '<[^>]*>|[*_`#]+', ' ', 'g'), '[a-z]{3,}')) AS word FROM documents) SELECT source, word, count(*) AS n FROM w WHERE word NOT IN ('the', 'and', 'for', 'with', 'its', 'their', 'this', 'that', 'both') GROUP BY ALL")
def q_token_counts(spark, d):
    return spans.word_counts(t(spark, d, "documents"), "text", ["source"])


@query("""
WITH w AS (SELECT lang, unnest(regexp_extract_all(regexp_replace(lower(text), '<[^>]*>|[*_`#]+', ' ', 'g'), '[a-z]{3,}')) AS word FROM documents),
c AS (SELECT word, count(*) FILTER (WHERE lang = 'de')::DOUBLE AS tt, count(*)::DOUBLE AS p FROM w WHERE word NOT IN ('the', 'and', 'for', 'with', 'its', 'their', 'this', 'that', 'both') GROUP BY word HAVING count(*) >= 5), s AS (SELECT sum(tt) AS nt, sum(p) AS np FROM c),
z AS (SELECT word, tt, p - tt AS b, tt + 500 * p / np AS yt, p - tt + 500 * p / np AS yb, nt, np FROM c, s)
SELECT word, tt::BIGINT AS n_target, b::BIGINT AS n_other, round((ln(yt / (nt + 500 - yt)) - ln(yb / (np - nt + 500 - yb))) / sqrt(1 / yt + 1 / yb), 4) AS z FROM z""")
def q_tokens_logodds(spark, d):
    c = spans.word_counts(t(spark, d, "documents"), "text", ["lang"])
    return spans.distinctive_words(c, F.col("lang") == "de").select("word", "n_target", "n_other", rnd("z", 4).alias("z"))


@query("WITH w AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL) SELECT word, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1")
def q_exclusive_words(spark, d):
    c = t(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return spans.exclusive_words(c, "lang", "n").select("word", "lang", "n")


@query("SELECT item_id, len(w)::INTEGER AS n_words, greatest(len(w) - 2, 0)::INTEGER AS n_trigrams, CASE WHEN len(w) >= 3 THEN w[1] || ' ' || w[2] || ' ' || w[3] END AS first_trigram FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def q_ngrams(spark, d):
    w = F.split("text", " ")
    g = text.ngrams(w, 3)
    return t(spark, d, "benchmark").select("item_id", F.size(w).alias("n_words"), F.size(g).alias("n_trigrams"), F.try_element_at(g, F.lit(1)).alias("first_trigram"))


@query("SELECT doc_id, ceil(len(l) / 3.0)::INTEGER AS n_windows, len(l)::INTEGER AS n_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def q_sentence_windows(spark, d):
    lines = F.split("text", "\n", -1)
    return t(spark, d, "documents").select("doc_id", F.size(text.windows(lines, 5, 3)).alias("n_windows"), F.size(lines).alias("n_lines"))


@query("SELECT item_id, doc_id, (strpos(d.text, b.text) - 1)::INTEGER AS start, (strpos(d.text, b.text) - 1 + length(b.text))::INTEGER AS \"end\" FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0")
def q_quote_locate(spark, d):
    # a quote's second to fourth words stand whole in every text that holds it, so texts and quotes meet by these three
    w = F.split("quote", " ")
    b = t(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")).withColumn("anchor", F.when(F.size(w) >= 5, F.array_join(F.slice(w, 2, 3), " ")))
    docs = t(spark, d, "documents").select("doc_id", "text")
    places = docs.select("doc_id", F.explode(F.array_distinct(text.ngrams(F.split("text", " "), 3))).alias("anchor"))
    met = places.join(b.where("anchor is not null"), "anchor").select("doc_id", "item_id", "quote")
    # quotes too short for that are compared with every text
    short = docs.join(b.where("anchor is null and quote != ''").drop("anchor"), F.contains("text", "quote"))
    j = docs.join(met, "doc_id").unionByName(short, allowMissingColumns=True).where(F.contains("text", "quote"))
    return j.withColumn("q", text.locate_quote(F.col("text"), F.col("quote"))).where("q.method = 'exact'").select("item_id", "doc_id", F.col("q.start").alias("start"), F.col("q.end").alias("end"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json_attrs(spark, d):
    return nested.attributes(t(spark, d, "events"), "props", ["k"]).select("event_id", "k")


@query("""
WITH n AS (SELECT user_id, count(DISTINCT event_id) AS n_docs FROM events GROUP BY 1)
SELECT user_id, n_docs, round(count(e.event_id) FILTER (WHERE event_type = 'click') * 100.0 / n_docs, 6) AS click, round(count(e.event_id) FILTER (WHERE event_type = 'purchase') * 100.0 / n_docs, 6) AS purchase FROM n LEFT JOIN (SELECT * FROM events WHERE value > 30) e USING (user_id) GROUP BY user_id, n_docs""")
def q_rates_with_denominator(spark, d):
    e = t(spark, d, "events")
    r = spans.rates_per(e.where("value > 30"), e, ["user_id"], "event_type", ["click", "purchase"], "event_id")
    return r.select("user_id", "n_docs", rnd("click").alias("click"), rnd("purchase").alias("purchase"))


CUES = "SELECT user_id AS pair_id, event_type AS cue, CASE WHEN event_id % 3 = 0 THEN 'A' ELSE 'B' END AS image, CASE WHEN user_id % 2 = 0 THEN 'More' WHEN user_id % 3 = 0 THEN 'Same' ELSE 'Less' END AS label FROM events"


@query(f"""
WITH v AS (SELECT pair_id, cue, min(image) AS im, min(label) AS label FROM ({CUES}) GROUP BY ALL HAVING min(image) = max(image)),
c AS (SELECT cue, count(*) AS n_mentions, count(*) FILTER (WHERE label <> 'Same') AS n, count(*) FILTER (WHERE (im = 'A' AND label = 'More') OR (im = 'B' AND label = 'Less')) AS wins FROM v GROUP BY cue HAVING count(*) FILTER (WHERE label <> 'Same') >= 1), b AS (SELECT sum(wins) / sum(n) AS base FROM c)
SELECT cue, n_mentions, n, wins, round(wins / n, 6) AS win_rate, round((wins + 25 * base) / (n + 25), 6) AS shrunk_rate FROM c, b""")
def q_win_rates(spark, d):
    x = t(spark, d, "events").select(F.col("user_id").alias("pair_id"), F.col("event_type").alias("cue"), F.when(F.col("event_id") % 3 == 0, "A").otherwise("B").alias("image"), F.when(F.col("user_id") % 2 == 0, "More").when(F.col("user_id") % 3 == 0, "Same").otherwise("Less").alias("presented_label"))
    return spans.win_rates(x, least=1).select("cue", "n_mentions", "n", "wins", rnd("win_rate").alias("win_rate"), rnd("shrunk_rate").alias("shrunk_rate"))


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10""")
def q_vector_topk(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return vectors.top_k(e, "embedding", q, 10, "vec_id").select("vec_id", rnd("score").alias("score"))


@query("""
WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), l AS (SELECT i, min(x) AS lo, max(x) AS hi FROM u GROUP BY i)
SELECT vec_id, sum(trunc((x - lo) / (hi - lo) * 255))::BIGINT AS total FROM u JOIN l USING (i) GROUP BY vec_id""")
def q_quantize(spark, d):
    q = vectors.quantize(t(spark, d, "embeddings"), "embedding")
    return q.select("vec_id", F.aggregate("quantized", F.lit(0), lambda s, x: s + x).cast("long").alias("total"))


@query("SELECT a.vec_id AS vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_cosine(spark, d):
    e = t(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", rnd(nested.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("""
SELECT c_custkey, round(2 * 6371000 * asin(sqrt(power(sin(radians(c_nationkey - c_acctbal / 200) / 2), 2) + cos(radians(c_acctbal / 200)) * cos(radians(c_nationkey)) * power(sin(radians(c_custkey % 90 - 10) / 2), 2))), 2) AS dist,
 round((degrees(atan2(sin(radians(c_custkey % 90 - 10)) * cos(radians(c_nationkey)), cos(radians(c_acctbal / 200)) * sin(radians(c_nationkey)) - sin(radians(c_acctbal / 200)) * cos(radians(c_nationkey)) * cos(radians(c_custkey % 90 - 10)))) + 360) % 360, 5) AS bearing FROM customer""")
def q_haversine_bearing(spark, d):
    c = t(spark, d, "customer")
    p = (F.col("c_acctbal") / 200, F.lit(10.0), F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 90).cast("double"))
    return c.select("c_custkey", rnd(geo.haversine_m(*p), 2).alias("dist"), rnd(geo.bearing_deg(*p), 5).alias("bearing"))


@query("SELECT c_custkey, least(((c_custkey * 37) % 720) % 360, 360 - ((c_custkey * 37) % 720) % 360)::DOUBLE AS turn FROM customer")
def q_angle(spark, d):
    return t(spark, d, "customer").select("c_custkey", geo.angle_between(((F.col("c_custkey") * 37) % 720).cast("double"), F.lit(0.0)).alias("turn"))


@query("""
WITH p AS (SELECT c_custkey, c_acctbal AS x, c_custkey * 10.0 AS y FROM customer), z AS (SELECT n_nationkey AS zone, n_nationkey * 400.0 AS x0, n_nationkey * 400.0 + 500 AS x1, n_nationkey * 300.0 AS y0, n_nationkey * 300.0 + 4000 AS y1 FROM nation),
j AS (SELECT c_custkey, zone, sqrt(power(x - (x0 + x1) / 2, 2) + power(y - (y0 + y1) / 2, 2)) AS dd FROM p JOIN z ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT c_custkey, zone, round(dd, 4) AS centroid_dist FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dd, zone) AS rn FROM j) WHERE rn = 1""")
def q_pip_grid(spark, d):
    p = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 10.0).alias("y"))
    k = F.col("n_nationkey")
    corner = lambda a, b: F.struct((k * 400.0 + a).alias("x"), (k * 300.0 + b).alias("y"))
    z = t(spark, d, "nation").select(k.alias("zone"), F.array(corner(0.0, 0.0), corner(500.0, 0.0), corner(500.0, 4000.0), corner(0.0, 4000.0)).alias("ring"))
    return spatial.closest_polygon(p, z, "c_custkey", "x", "y", "ring", "zone", 500.0, 0.0).withColumn("centroid_dist", rnd("centroid_dist", 4))


@query("""
WITH r AS (SELECT c_custkey, c_acctbal / 10 AS x, (c_custkey % 1000)::DOUBLE AS y, radians(((c_custkey * 37) % 360)::DOUBLE) AS b, c_nationkey / 25.0::DOUBLE AS s FROM customer), p AS (SELECT c_custkey, s, floor((y + k / 25.0::DOUBLE * 50 * cos(b)) / 10)::BIGINT AS row, floor((x + k / 25.0::DOUBLE * 50 * sin(b)) / 10)::BIGINT AS col, 1 - k / 25.0::DOUBLE AS w FROM r, range(1, 26) v(k)),
o AS (SELECT c_custkey, row, col, max(w) AS w, max(s) AS s FROM p GROUP BY ALL) SELECT row, col, round(sum(s * w) / nullif(sum(w), 0), 6) AS value, count(*) AS n FROM o GROUP BY ALL""")
def q_rays(spark, d):
    c = t(spark, d, "customer").select((F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"), ((F.col("c_custkey") * 37) % 360).cast("double").alias("b"), (F.col("c_nationkey") / 25.0).alias("s"))
    return spatial.ray_raster(c, "x", "y", "b", "s", 50.0, 10.0).withColumn("value", rnd("value"))


@query("""
WITH j AS (SELECT s_suppkey, c_custkey, c_acctbal AS v, sqrt(power(s_acctbal - c_acctbal, 2) + power((s_nationkey - c_nationkey) * 100.0::DOUBLE, 2)) AS dd FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 150 AND abs(s_nationkey - c_nationkey) <= 1), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY dd, c_custkey) AS k FROM j WHERE dd <= 150)
SELECT s_suppkey, round(coalesce(avg(v) FILTER (WHERE dd < 1e-9), sum(v / power(greatest(dd, 1e-9), 2)) / sum(1 / power(greatest(dd, 1e-9), 2))), 4) AS value, count(*) AS n FROM r WHERE k <= 8 GROUP BY 1""")
def q_idw(spark, d):
    p = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"), F.col("c_acctbal").alias("v"))
    cells = t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    return spatial.idw(p, cells, "v", "s_suppkey", "c_custkey", 150.0).withColumn("value", rnd("value", 4))


@query()
def q_rating_fold(spark, d):
    e = t(spark, d, "lineitem").select("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"), (F.col("l_partkey") % 40).alias("a"), (F.col("l_suppkey") % 40).alias("b"), F.signum(F.col("l_quantity") - 25).alias("s"))
    e = e.withColumn("seq", F.xxhash64("seq"))
    r = models.fold_ratings(e, ["l_returnflag"], "seq", "a", "b", "s")
    return r.select("l_returnflag", "unit_uid", rnd("mu").alias("mu"), rnd("sigma").alias("sigma"), "n_comparisons")


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - c_custkey % 10 + (c_custkey * 7) % 10 AS b FROM customer), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def q_components(spark, d):
    from quadrat.sources.storage import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    k = F.col("c_custkey")
    e = t(spark, d, "customer").select(k.alias("src"), (k - k % 10 + (k * 7) % 10).alias("dst"))
    return graph.connected_components(e)


@query("""
WITH n AS (SELECT s_suppkey AS id, 40 + s_acctbal / 100000 AS la, -74 + (s_suppkey % 100) / 1000.0 AS lo FROM supplier),
j AS (SELECT a.id AS src, b.id AS dst, 2 * 6371000 * asin(sqrt(power(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * power(sin(radians(b.lo - a.lo) / 2), 2))) AS dd FROM n a JOIN n b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dd, dst) AS rn FROM j WHERE dd <= 1500)
SELECT src, dst, round(dd, 3) AS distance_m FROM r WHERE rn <= 4""")
def q_knn(spark, d):
    n = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (40 + F.col("s_acctbal") / 100000).alias("lat"), (-74 + (F.col("s_suppkey") % 100) / 1000.0).alias("lon"))
    return graph.knn_graph(n, "id", 4, 1500.0).select("src", "dst", rnd("distance_m", 3).alias("distance_m"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_st_tumbling(spark, d):
    r = streams.tumbling(t(spark, d, "events"), "ts", "1 hour", ["event_type"], value="value")
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", rnd("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS window_start, event_type, count(*) AS n FROM events, range(3) r(i) GROUP BY ALL")
def q_st_sliding(spark, d):
    r = streams.sliding(t(spark, d, "events"), "ts", "3 hours", "1 hour", ["event_type"])
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""
WITH b AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000000 THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM b)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def q_st_session(spark, d):
    r = streams.gap_sessions(t(spark, d, "events"), "ts", "6 hours", ["user_id"])
    return r.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("""
SELECT 'price_positive' AS rule, true AS fatal, count(*) AS n_rows, count(*) FILTER (WHERE NOT l_extendedprice > 0) AS n_bad, count(*) FILTER (WHERE NOT l_extendedprice > 0) = 0 AS passed FROM lineitem UNION ALL
SELECT 'small_discount', false, count(*), count(*) FILTER (WHERE l_discount > 0.05), count(*) FILTER (WHERE l_discount > 0.05) <= 0.1 * count(*) FROM lineitem UNION ALL
SELECT 'order_exists', true, count(*), count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FILTER (WHERE o_orderkey IS NULL) = 0 FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) ON l_orderkey = o_orderkey UNION ALL
SELECT 'order_unique', true, (SELECT count(*) FROM orders), (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) = 0""")
def q_validation_report(spark, d):
    x, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    r = validation.report(x, [validation.Rule("price_positive", ~(F.col("l_extendedprice") > 0), True), validation.Rule("small_discount", F.col("l_discount") > 0.05, allow=0.1)])
    return r.unionByName(validation.references("order_exists", x, "l_orderkey", o, "o_orderkey")).unionByName(validation.unique("order_unique", ["o_orderkey"], o))


@query("SELECT count(*) AS raw, count(*) FILTER (WHERE c_acctbal > 0) AS positive, count(*) FILTER (WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING') AS building FROM customer")
def q_funnel_counts(spark, d):
    return rows.funnel(t(spark, d, "customer"), [("positive", F.col("c_acctbal") > 0), ("building", F.col("c_mktsegment") == "BUILDING")])[1]


@query("SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tn / nullif(tn + fn, 0), 6) AS npv FROM (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)")
def q_classifier_metrics(spark, d):
    x = t(spark, d, "labels").select((F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("x"))
    return judgments.classifier_metrics(x, "q", "x").select("tp", "fp", "fn", "tn", rnd("accuracy").alias("accuracy"), rnd("npv").alias("npv"))


@query("SELECT l.event_id, l.user_id, (SELECT max(r.event_id) FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'purchase' AND r.ts = (SELECT max(ts) FROM events m WHERE m.user_id = l.user_id AND m.event_type = 'purchase' AND m.ts <= l.ts)) AS last_purchase FROM events l WHERE l.event_type = 'click'")
def q_as_of(spark, d):
    e = t(spark, d, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("p"))
    return timeline.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "p", "last_purchase").select("event_id", "user_id", "last_purchase")


@query()
def q_stratified(spark, d):
    return sampling.stratified(t(spark, d, "customer"), "c_mktsegment", 100, 3, "c_custkey").select("c_custkey", "c_mktsegment")


@query()
def q_hash_split(spark, d):
    return sampling.split_within(t(spark, d, "customer"), "c_mktsegment", 0.8, 5, "c_custkey").select("c_custkey", "c_mktsegment", "split")


@query()
def q_pairs_distinct(spark, d):
    return sampling.pair_table(sampling.distinct_pairs(t(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 200, 9), 2)


@query()
def q_unit_pairs(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", "c_custkey", F.greatest(F.lit(0.0), F.col("c_acctbal")).alias("w"))
    return sampling.unit_pairs(c, "c_nationkey", "c_custkey", "w", 50, 4)


@query()
def q_code_ladder(spark, d):
    """Complexity codes of synthetic traces: every conversation turn is an ingredient."""
    kinds = F.array(*map(F.lit, spans.KINDS))
    c = t(spark, d, "conversations")
    r = c.select(F.lit("demo").alias("case"), F.lit("m").alias("judge_model"), F.col("conv_id").alias("doc_id"), F.get(kinds, F.pmod(F.xxhash64("text"), F.lit(7)).cast("int")).alias("ingredient_type"), F.col("turn").cast("int").alias("ingredient_index"), F.col("text").alias("name"), F.lit(True).alias("quote_found"), F.lit(False).alias("answer_truncated"), F.col("turn").cast("int").alias("char_start"),
                 F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, "A").otherwise("B").alias("image"), F.col("role").alias("label"), F.array(F.struct(F.lit("exact").alias("method"))).alias("justification_quotes"))).alias("attrs_json"))
    return spans.trace_codes(r).select("doc_id", "n_ingredients", "differentiated", "integrated", "verdict_labels", "ic_code")


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS hits, round(count(*) FILTER (WHERE o_totalprice > 150000) / count(*), 6) AS rate FROM orders GROUP BY 1")
def q_rate_by_group(spark, d):
    return reports.rate_by(t(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice") > 150000).select("o_orderpriority", "n", "hits", rnd("rate").alias("rate"))


@query("""
WITH e AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) AS e FROM orders), b AS (SELECT *, CASE WHEN o_totalprice <= e[2] THEN 0 WHEN o_totalprice <= e[3] THEN 1 WHEN o_totalprice <= e[4] THEN 2 ELSE 3 END AS band, o_orderstatus = 'F' AS fl, o_custkey % 3 = 0 AS hit FROM orders, e),
g AS (SELECT band, avg(hit::INT) FILTER (WHERE fl) AS rt, avg(hit::INT) FILTER (WHERE NOT fl) AS rf, least(count(*) FILTER (WHERE fl), count(*) FILTER (WHERE NOT fl)) AS w FROM b GROUP BY band)
SELECT round(sum((rt - rf) * w) / sum(w), 6) AS contrast, sum(w)::BIGINT AS weight FROM g WHERE rt IS NOT NULL AND rf IS NOT NULL""")
def q_contrast(spark, d):
    o = t(spark, d, "orders").withColumn("fl", F.col("o_orderstatus") == "F")
    return reports.pooled_contrast(reports.rate_by_gap(o, "o_totalprice", "fl", F.col("o_custkey") % 3 == 0)).select(rnd("contrast").alias("contrast"), "weight")


@query("""
WITH m AS (SELECT p_type, avg(p_retailprice) FILTER (WHERE p_brand = 'Brand#11') AS a, avg(p_retailprice) FILTER (WHERE p_brand = 'Brand#12') AS b FROM part GROUP BY 1), n AS (SELECT p_type, (coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0) AS mean FROM m), r AS (SELECT *, row_number() OVER (ORDER BY mean DESC NULLS LAST, p_type) AS rank, count(*) OVER () AS c FROM n)
SELECT p_type, round(mean, 4) AS mean, rank::INTEGER AS rank, CASE WHEN rank <= 2 THEN 'top' WHEN rank > c - 2 THEN 'bottom' ELSE 'middle' END AS slice FROM r WHERE rank <= 2 OR rank > c - 2 OR (rank > floor((c - 2) / 2) AND rank <= floor((c - 2) / 2) + 2)""")
def q_bands_top_bottom(spark, d):
    m = reports.model_means(t(spark, d, "part"), "p_type", "p_brand", "p_retailprice", ["Brand#11", "Brand#12"])
    return reports.slices(m, "rank", 2).select("p_type", rnd("mean", 4).alias("mean"), "rank", "slice")


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def q_profile(spark, d):
    p = reports.profile(t(spark, d, "events"), "value", ["event_type"])
    return p.select("event_type", "n", *[rnd(c).alias(c) for c in ("min", "mean", "max", "p05", "p50", "p95")])


@query("WITH x AS (SELECT lang, unnest(string_split(source, 'c')) AS i FROM documents) SELECT lang, array_to_string(list_sort(list(DISTINCT i)), '|') AS items, count(*) AS n_items FROM x WHERE length(trim(i)) > 0 GROUP BY lang")
def q_list_flatten(spark, d):
    x = t(spark, d, "documents").select("lang", F.split("source", "c").alias("items"))
    return reports.flattened(x, ["lang"], "items").withColumn("items", F.array_join("items", "|"))


@query("SELECT c_nationkey, count(*) AS n_keys, coalesce(sum(c), 0)::BIGINT AS n_rows, count(*) FILTER (WHERE c IS NULL) AS n_silent, count(*) FILTER (WHERE c > 1) AS n_repeated, round(coalesce(sum(c), 0) / count(*), 6) AS rows_per_key FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS c FROM orders WHERE o_totalprice > 250000 GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1")
def q_coverage(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", "c_custkey")
    o = t(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey")
    return reports.coverage(c, o, ["c_nationkey"], "c_custkey").withColumn("rows_per_key", rnd("rows_per_key"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS k, round(count(*) FILTER (WHERE o_orderpriority = '5-LOW') / count(*), 6) AS rate FROM orders GROUP BY 1")
def q_probe_arms(spark, d):
    return reports.probe_arms(t(spark, d, "orders"), "o_orderstatus", F.col("o_orderpriority") == "5-LOW").select("o_orderstatus", "n", "k", rnd("rate").alias("rate"))


@query("""
WITH j AS (SELECT l_orderkey, l_linenumber, a.p_retailprice - b.s_acctbal AS gap, sign(l_quantity - 25) AS s FROM lineitem JOIN part a ON l_partkey = p_partkey JOIN supplier b ON l_suppkey = s_suppkey)
SELECT count(*) AS n, round(avg(abs(gap)), 4) AS gap, count(*) FILTER (WHERE sign(gap) = s) AS agrees FROM j WHERE gap <> 0 AND s <> 0""")
def q_gap_table(spark, d):
    x = t(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("u_a"), F.concat(F.lit("s"), "l_suppkey").alias("u_b"), F.signum(F.col("l_quantity") - 25).alias("s"))
    v = t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("u"), F.col("p_retailprice").alias("v")).unionByName(t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("u"), F.col("s_acctbal").alias("v")))
    return reports.gap_table(x, v, "u", "v", "s").agg(F.count("*").alias("n"), rnd(F.avg("gap"), 4).alias("gap"), F.count_if("agrees").alias("agrees"))


@query("WITH m AS (SELECT median(o_totalprice) AS a, median(o_custkey) AS b FROM orders) SELECT count(*) AS n, round(avg(((o_totalprice > a) = (o_custkey > b))::INT), 6) AS share FROM orders, m")
def q_same_side(spark, d):
    return models.same_side_of_median(t(spark, d, "orders"), "o_totalprice", "o_custkey").select("n", rnd("share").alias("share"))


@query("SELECT p_partkey, (CASE WHEN p_size * 40 <= 512 THEN 1 ELSE 1 + ceil((p_size * 40 - 512) / 448.0) END)::BIGINT AS n_tiles, least(512, p_size * 40)::BIGINT AS tile_w FROM part")
def q_tiles(spark, d):
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("w"), F.lit(300).alias("h"))
    return boxes.tiles(p, "w", "h", 512, 64).groupBy("p_partkey").agg(F.count("*").alias("n_tiles"), F.max("tile_w").cast("long").alias("tile_w"))


@query("WITH c AS (SELECT floor(value / 25)::INTEGER AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT bin, label, coalesce(n, 0) AS n FROM (VALUES (0, 'low'), (1, 'mid'), (2, 'high'), (99, 'none')) v(bin, label) LEFT JOIN c USING (bin)")
def q_binned(spark, d):
    return reports.binned(t(spark, d, "events"), "value", 25.0, {0: "low", 1: "mid", 2: "high", 99: "none"})


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p_size DESC, p_brand) AS r1 FROM part) WHERE r1 = 1) WHERE r2 = 1")
def q_best_twice(spark, d):
    return reports.best_twice(t(spark, d, "part"), "p_brand", "p_partkey", "p_size").select("p_brand", "p_partkey", "p_size")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) BETWEEN 20 AND 310")
def q_candidates_in_range(spark, d):
    return reports.candidates_in_range(t(spark, d, "customer"), "c_mktsegment", 20, 310)


@query("SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"F\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"O\" FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def q_newest_wide(spark, d):
    o = t(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return reports.newest_wide(o, "o_orderpriority", "y", "o_orderstatus", "o_totalprice", ["F", "O"]).select("o_orderpriority", rnd("F", 4).alias("F"), rnd("O", 4).alias("O"))


@query("SELECT event_type, user_id % 10 AS arm, count(*) AS n, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS rows_per_s FROM events GROUP BY ALL")
def q_runtime_stats(spark, d):
    e = t(spark, d, "events").withColumn("arm", F.col("user_id") % 10)
    return reports.runtime_stats(e, ["event_type", "arm"], "ts", "ts").select("event_type", "arm", "n", rnd("rows_per_s", 9).alias("rows_per_s"))


@query("SELECT lang, count(source) AS n, count(*) FILTER (WHERE source NOT IN ('src0', 'src1')) AS n_outside FROM documents GROUP BY 1")
def q_vocabulary_report(spark, d):
    return reports.vocabulary_report(t(spark, d, "documents"), ["lang"], "source", ["src0", "src1"]).drop("outside")
