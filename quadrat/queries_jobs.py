"""Queries over batch jobs, files, registries, small statistics and texts, beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import columns, nested, stats, text
from quadrat.operators import batch_map, reports, sampling, timeline, vectors
from quadrat.plans import dag, normalize, validation
from quadrat.queries_curation import scratch
from quadrat.registry import query, rnd, t
from quadrat.sources import paged, rasters, readers, writers
from quadrat.streaming import events as streams

# --- jobs


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey * 2 END::BIGINT AS twice, c_custkey % 10 = 0 AS failed FROM customer")
def q_batch_map(spark, d):
    def run(rows):
        if any(r["c_custkey"] % 10 == 0 for r in rows):
            raise RuntimeError("no answer")
        return [{"twice": r["c_nationkey"] * 2} for r in rows]

    got = batch_map.batch_map(t(spark, d, "customer"), run, "twice long", ["c_custkey", "c_nationkey"], ["c_custkey"], chunk=1)
    return got.select("c_custkey", "twice", F.col("error").isNotNull().alias("failed"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def q_rows_to_do(spark, d):
    c, k = t(spark, d, "customer").select("c_custkey"), F.col("c_custkey")
    done = c.where("c_custkey % 3 <> 0").withColumn("error", F.when(k % 5 == 0, "late"))
    return batch_map.rows_to_do(c, done, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'large' END ELSE 'small' END AS decision, CASE WHEN o_totalprice > 200000 THEN CASE WHEN o_orderstatus = 'F' THEN 'yy' ELSE 'yn' END ELSE 'n' END AS path FROM orders")
def q_decision_tree(spark, d):
    tree = {"if": "o_totalprice > 200000", "then": {"if": "o_orderstatus = 'F'", "then": "closed", "else": "large"}, "else": "small"}
    return batch_map.decision_tree(t(spark, d, "orders"), tree, path="path").select("o_orderkey", "decision", "path")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def q_dag_run(spark, d):
    registry = dag.Registry()
    registry.stage("keep")(lambda s, inputs, settings: {"rows": inputs["rows"].where(F.col("c_acctbal") > settings["least"])})
    registry.stage("count")(lambda s, inputs, settings: {"table": inputs["rows"].groupBy("c_mktsegment").agg(F.count("*").alias("n"))})
    spec = {"sources": {"customers": f"{d}/customer.parquet"}, "nodes": {"count": {"stage": "count", "inputs": {"rows": "keep.rows"}, "outputs": {"table": None}}, "keep": {"stage": "keep", "inputs": {"rows": "customers"}, "outputs": {"rows": scratch(spark, "kept")}, "settings": {"least": 0}}}}
    return registry.run(spark, dag.Pipeline.from_dict(spec), {"keep": {"least": 100}})["count.table"]


@query("SELECT 0::BIGINT AS missing_shards, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0) AS keys_in_two_shards, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0) AS repeated_keys")
def q_shard_grid(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("shard"))
    again = s.where("s_suppkey % 5 = 0").withColumn("shard", (F.col("shard") + 1) % 4).unionByName(s.where("s_suppkey % 7 = 0"))
    return validation.shard_grid(s.unionByName(again), "shard", "s_suppkey", 4)


@query("WITH c AS (SELECT o_orderpriority, count(*) AS c, count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS t FROM orders GROUP BY 1) SELECT sum(c)::BIGINT AS n_rows, round(max(c) / sum(c), 6) AS top_share, round(sum(t) / sum(c), 6) AS trace_share, sum(c) >= 1000 AND max(c) / sum(c) <= 0.98 AND sum(t) / sum(c) >= 0.95 AS ok FROM c")
def q_run_gates(spark, d):
    o = t(spark, d, "orders").withColumn("trace", F.when(F.col("o_orderkey") % 50 == 0, "  ").otherwise("because"))
    return validation.run_gates(o, "o_orderpriority", "trace").withColumn("top_share", rnd("top_share")).withColumn("trace_share", rnd("trace_share"))


@query("SELECT count(*) AS n_groups, median(c) AS p50, round(quantile_cont(c, 0.95), 6) AS p95, max(c) AS max, round(avg(c), 6) AS mean FROM (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1)")
def q_group_sizes(spark, d):
    return validation.group_size_profile(t(spark, d, "orders"), "o_custkey").withColumn("p95", rnd("p95")).withColumn("mean", rnd("mean"))


@query("SELECT (i // 40)::INTEGER AS shard, least(40, n - i // 40 * 40) AS n FROM (SELECT count(*) AS n FROM customer), range(0, 1000000, 40) r(i) WHERE i < n")
def q_sharded(spark, d):
    return writers.sharded(t(spark, d, "customer"), 40, 1, "c_custkey").groupBy("shard").agg(F.count_distinct("c_custkey").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def q_missing_work(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return writers.missing_work(o.select("o_orderkey"), o.where("o_orderstatus = 'F'"), ["o_orderkey"])


# --- files

@query("""SELECT '{"data":{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}}' AS task FROM customer""")
def q_task_json(spark, d):
    return writers.task_json(t(spark, d, "customer"), ["c_custkey", "c_name"])


@query("""SELECT vec_id, '{"label":' || label || '}' AS nested, len(embedding)::INTEGER AS n FROM embeddings""")
def q_plain_columns(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.struct("label").alias("nested"), "embedding", F.lit(1).alias("heavy"))
    p = writers.plain(e, ["heavy"])
    return p.select("vec_id", "nested", F.size(F.from_json("embedding", "array<double>")).alias("n"))


@query("SELECT s_suppkey::VARCHAR AS id, s_acctbal AS x, s_nationkey * 1.0::DOUBLE AS y FROM supplier WHERE s_suppkey % 4 <> 0")
def q_geojson_points(spark, d):
    path = scratch(spark, "points")
    s = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    writers.write_geojson(s, path, "x", "y", ["s_suppkey"])
    part = lambda p: F.get_json_object("value", p)
    return spark.read.text(path).select(part("$.properties.s_suppkey").alias("id"), part("$.geometry.coordinates[0]").cast("double").alias("x"), part("$.geometry.coordinates[1]").cast("double").alias("y"))


@query("SELECT 'w' || n_regionkey AS dataset, 'r' || n_nationkey AS recording_id, n_name || '.jpg' IS NOT NULL AS listed, n_nationkey * 1.0::DOUBLE AS lat, -70.5::DOUBLE AS lon, n_nationkey % 5 <> 0 AS manifest_ok FROM nation")
def q_image_tree(spark, d):
    root = scratch(spark, "tree")
    # 25 recordings
    for r in t(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():
        folder = f"{root}/w{r.n_regionkey}/g/r{r.n_nationkey}"
        writers.write_json(spark, f"{folder}/faces/F.jpg", {"pixels": r.n_nationkey})
        writers.write_json(spark, f"{folder}/notes/F.txt", {})
        writers.write_json(spark, f"{folder}/manifest.json", {"imageId": f"r{r.n_nationkey}", "label": f"-70.5,{r.n_nationkey}"} if r.n_nationkey % 5 else "cut {")
    images = readers.list_images(spark, [root])
    m = readers.read_manifests(spark, root, "imageId string, label string")
    lat, lon = readers.parse_label(F.concat_ws(",", F.lit("-70.5"), F.substring("recording_dir", 2, 9)))
    found = images.join(m.select("recording_dir", F.col("manifest.imageId").isNotNull().alias("manifest_ok")), "recording_dir")
    return found.select("dataset", F.col("recording_dir").alias("recording_id"), (F.col("face") == "F").alias("listed"), lat.alias("lat"), lon.alias("lon"), "manifest_ok")


@query("SELECT lpad(n_nationkey::VARCHAR, 11, '0') AS geoid, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 100.0 END::DOUBLE AS value FROM nation")
def q_census(spark, d):
    path = scratch(spark, "census")
    k = F.col("n_nationkey")
    rows = t(spark, d, "nation").select(F.concat(F.lit("1400000US"), F.lpad(k.cast("string"), 11, "0")).alias("GEO_ID"), F.when(k % 4 == 0, "-").otherwise((k * 100).cast("string")).alias("income"))
    caption = spark.createDataFrame([("Geography", "Estimate")], "GEO_ID string, income string")
    caption.unionByName(rows).coalesce(1).write.csv(path, header=True)
    return readers.read_census(spark, path, "GEO_ID", "income")


@query("SELECT 'j' || event_id AS job, CASE WHEN event_id % 6 = 0 THEN NULL ELSE date_trunc('second', ts) END AS start, event_type AS kind FROM events")
def q_accounting_text(spark, d):
    path = scratch(spark, "jobs")
    line = F.concat_ws("|", F.concat(F.lit("j"), F.col("event_id").cast("string")), F.when(F.col("event_id") % 6 == 0, "Unknown").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), "event_type")
    t(spark, d, "events").select(line.alias("value")).write.text(path)
    return readers.read_jobs(spark, path, ["job", "start", "kind"])


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def q_sql_console(spark, d):
    return readers.sql(spark, "SELECT o_orderstatus AS status, count(*) AS n FROM recordings WHERE o_totalprice > :least GROUP BY 1", {"recordings": t(spark, d, "orders")}, least=1000)


@query("SELECT r_regionkey, r_name, true AS refused FROM region")
def q_guarded_read(spark, d):
    path, settings = scratch(spark, "pairs"), {"seed": 1, "n": [1, 2]}
    t(spark, d, "region").withColumn("_fingerprint", F.lit(writers.fingerprint(settings))).write.parquet(path)
    try:
        writers.guarded_read(spark, path, {"seed": 2})
        refused = False
    except ValueError:
        refused = True
    return writers.guarded_read(spark, path, {"n": [1, 2], "seed": 1}).withColumn("refused", F.lit(refused))


@query("SELECT i AS id, 'row ' || i AS name FROM range(2345) r(i)")
def q_paged_source(spark, d):
    def fetch(offset, limit):
        return [{"id": i, "name": f"row {i}"} for i in range(offset, offset + limit)]

    rows, cut = paged.read_paged(spark, fetch, 2345, page=500, name="paged_rows")
    return rows.select(F.from_json("value", "id long, name string").alias("r")).select("r.*").where(F.lit(not cut))


@query("SELECT event_id // 500 AS chunk, count(*) AS n FROM events GROUP BY 1")
def q_ordered_parts(spark, d):
    path = scratch(spark, "parts")
    e = t(spark, d, "events").select("event_id", (F.col("event_id") - F.col("event_id") % 500).alias("first"))
    e.write.partitionBy("first").parquet(path)
    p = readers.ordered_parts(spark, path).withColumn("chunk", F.floor(F.col("event_id") / 500))
    return p.where(F.col("_chunk").isNotNull()).groupBy("chunk").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM customer WHERE NOT (lower(c_mktsegment) LIKE '%build%' OR lower(c_mktsegment) LIKE '%mach%')")
def q_without_names(spark, d):
    return readers.without_names(t(spark, d, "customer"), "c_mktsegment", ["Build", "mach"]).agg(F.count("*").alias("n"))


# --- vectors and samples

@query("SELECT label, vec_id, rank::INTEGER AS rerank_rank FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE, 5) AS s FROM embeddings)) WHERE rank <= 3 AND s >= 0")
def q_rerank(spark, d):
    e = t(spark, d, "embeddings").select("label", "vec_id", F.round(F.get("embedding", 0).cast("double"), 5).alias("s"))
    return vectors.rerank(e, "s", "vec_id", 0, 3, ["label"]).select("label", "vec_id", "rerank_rank")


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS norm, true AS unit FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def q_normalized(spark, d):
    u = nested.normalized(F.col("embedding"))
    return t(spark, d, "embeddings").select("vec_id", rnd(nested.norm(F.col("embedding")), 5).alias("norm"), (F.abs(nested.norm(u) - 1) < 1e-9).alias("unit"))


@query("SELECT count(*) AS n, true AS in_range, true AS even, true AS repeats FROM orders")
def q_hash_unit(spark, d):
    """What a hash draw must hold: values in [0, 1), a mean near a half, the same value whenever it is drawn."""
    u = columns.hash_unit(7, F.col("o_orderkey"))
    o = t(spark, d, "orders").select("o_orderkey", u.alias("u"))
    again = o.join(t(spark, d, "orders").repartition(3).select("o_orderkey", u.alias("v")), "o_orderkey")
    return again.agg(F.count("*").alias("n"), F.bool_and(F.col("u").between(0, 0.9999999999999999)).alias("in_range"), (F.abs(F.avg("u") - 0.5) < 0.05).alias("even"), F.bool_and(F.col("u") == F.col("v")).alias("repeats"))


@query("SELECT least(60, count(*)) AS n, least(60, count(*)) AS n_ids FROM customer")
def q_preview(spark, d):
    p = writers.preview(t(spark, d, "customer"), "c_custkey", ["c_name", "absent"], ["c_acctbal"], 60)
    assert p.columns[0] == "c_name" and "c_acctbal" not in p.columns
    return p.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("n_ids"))


@query("SELECT least(50, count(*)) AS n, least(50, count(*)) AS n_ids, true AS spread FROM customer")
def q_grid_seeds(spark, d):
    c = t(spark, d, "customer")
    s = sampling.grid_seeds(c, "c_custkey", F.col("c_nationkey"), F.lit(0), 50, 2)
    # as many nodes as cells or more reach every cell
    cells = s.agg(F.count_distinct("c_nationkey").alias("k")).join(c.agg(F.count_distinct("c_nationkey").alias("all")), F.lit(True)).select((F.col("k") >= F.col("all") * 0.6).alias("spread"))
    return s.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("n_ids")).join(cells, F.lit(True))


@query("SELECT \"end\", count(*) AS n FROM (SELECT c_nationkey, max(c_acctbal) AS m FROM customer GROUP BY 1), (VALUES ('top'), ('bottom')) v(\"end\") WHERE (SELECT count(*) FROM (SELECT c_nationkey AS k, max(c_acctbal) AS m2 FROM customer GROUP BY 1) WHERE (\"end\" = 'top' AND (m2 > m OR m2 = m AND k < c_nationkey)) OR (\"end\" = 'bottom' AND (m2 < m OR m2 = m AND k < c_nationkey))) < 4 GROUP BY 1")
def q_examples(spark, d):
    return reports.examples(t(spark, d, "customer"), F.col("c_acctbal"), "c_nationkey", 4, 1).groupBy("end").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, a.n_regionkey AS zone_a, b.n_regionkey AS zone_b FROM orders LEFT JOIN nation a ON a.n_nationkey = o_custkey % 30 LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 30")
def q_sided_zones(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).cast("int").alias("u_a"), (F.col("o_orderkey") % 30).cast("int").alias("u_b"))
    z = t(spark, d, "nation").select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("zone"))
    return reports.sided_zones(o, z, "u", "zone").select("o_orderkey", "zone_a", "zone_b")


# --- statistics and texts

@query("""
WITH g AS (SELECT c_nationkey, count(*)::DOUBLE AS n, count(*) FILTER (WHERE c_acctbal > 0)::DOUBLE AS k, 3.841458820694124::DOUBLE AS z2, 1.959963984540054::DOUBLE AS z FROM customer GROUP BY 1)
SELECT c_nationkey, round(greatest(0, (k / n + z2 / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (k / n + z2 / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high, round((k + 5) / (n + 10), 6) AS shrunk FROM g""")
def q_intervals(spark, d):
    g = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("c_nationkey", rnd(lo).alias("low"), rnd(hi).alias("high"), rnd(stats.shrunk(F.col("k"), F.col("n"), F.lit(0.5), 10.0)).alias("shrunk"))


@query("""
WITH c AS (SELECT o_orderpriority AS p, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE AS b FROM orders GROUP BY 1), s AS (SELECT p, a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM c)
SELECT round(sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2)), 6) AS distance FROM s""")
def q_jensen_shannon(spark, d):
    c = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    side = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", x))), lambda s: s[x])
    return c.agg(rnd(stats.jensen_shannon(side("a"), side("b"))).alias("distance"))


@query("SELECT item_id, len(list_filter(string_split(text, '. '), lambda x: length(trim(x)) >= 1))::INTEGER AS n_sentences FROM benchmark WHERE NOT regexp_matches(text, '[!?\\n]') AND NOT regexp_matches(text, '\\.[^ ]') AND NOT regexp_matches(text, '\\.  ')")
def q_sentences(spark, d):
    b = t(spark, d, "benchmark").where(~F.col("text").rlike(r"[!?\n]") & ~F.col("text").rlike(r"\.[^ ]") & ~F.col("text").rlike(r"\.  "))
    return b.select("item_id", F.size(text.sentences(F.col("text"), 1, None)).alias("n_sentences"))


@query("SELECT c_custkey, lower(c_mktsegment) AS key, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS residual, lower(c_mktsegment[1:4]) || '_' || sha1(c_mktsegment)[1:8] AS short FROM customer")
def q_span_keys(spark, d):
    s, k = F.col("c_mktsegment"), F.col("c_custkey")
    phrase = F.when(k % 2 == 0, " No  visible\ndifference. ").otherwise("plain")
    return t(spark, d, "customer").select("c_custkey", text.span_key(F.concat(F.lit(" \""), s, F.lit("\"!  "))).alias("key"), text.residual_ratio(phrase, ["visible", "no visible difference"]).alias("residual"), columns.slug(s, 4).alias("short"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS n, CASE WHEN c_custkey % 2 = 0 THEN 'clean platform here.' ELSE 'clean platform here.' END AS best FROM customer")
def q_verify_claims(spark, d):
    from quadrat.operators import spans

    evidence = F.when(F.col("c_custkey") % 2 == 0, "Dark and crowded stairs. clean platform here.").otherwise("clean platform here.")
    c = t(spark, d, "customer").select("c_custkey", F.lit("the clean platform").alias("claim"), evidence.alias("evidence"))
    v = spans.verify_claims(c, "claim", "evidence", 2)
    return v.select("c_custkey", F.size("evidence_top").alias("n"), F.get("evidence_top", 0)["sentence"].alias("best"))


@query("SELECT user_id, event_type, 1::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def q_once_per_key(spark, d):
    return streams.once_per_key(t(spark, d, "events"), "ts", ["user_id", "event_type"], "1 hour").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT unnest(['Manhattan', 'Bronx']) AS borough, true AS refused")
def q_vocabulary(spark, d):
    try:
        normalize.vocabulary_or_raise(["Bronks"], ["Bronx"])
        refused = False
    except ValueError as e:
        refused = "Bronx" in str(e)
    names = normalize.vocabulary_or_raise([" manhattan", "BRONX "], ["Manhattan", "Bronx", "Queens"])
    return spark.createDataFrame([(n, refused) for n in names], "borough string, refused boolean")


@query("""
WITH s AS (SELECT user_id, 10.0 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events WHERE event_id % 2 = 0), g AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1)
SELECT user_id, ceil(n / 3.0)::INTEGER AS n_windows, round(10.0 * n - 8 + 8 - 10 - 2 * (ceil(n / 3.0) - 1) + 8, 6)::DOUBLE AS covered FROM g""")
def q_pack_segments(spark, d):
    """Intervals of 8 s every 10 s: three fill a window of 30 s, gaps of 2 s between windows are not covered."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    s = t(spark, d, "events").where("event_id % 2 = 0").select("user_id", F.struct((i * 10.0).cast("double").alias("start"), (i * 10.0 + 8).cast("double").alias("end")).alias("x"))
    packed = timeline.pack_segments(F.col("xs"), 30.0, 2.0)
    return s.groupBy("user_id").agg(F.collect_list("x").alias("xs")).select("user_id", F.size(packed).alias("n_windows"), rnd(F.aggregate(packed, F.lit(0.0), lambda a, w: a + w["end"] - w["start"])).alias("covered"))


@query("SELECT 'img' || n_nationkey AS name, 'jpg' AS extension, (n_nationkey % 3)::INTEGER AS depth, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || n_regionkey ELSE 'a' || n_regionkey || '/b' END AS folders FROM nation")
def q_image_table(spark, d):
    root = scratch(spark, "images")
    # 25 images
    for r in t(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():
        folders = ["", f"a{r.n_regionkey}/", f"a{r.n_regionkey}/b/"][r.n_nationkey % 3]
        writers.write_json(spark, f"{root}/{folders}img{r.n_nationkey}.jpg", {})
    return rasters.image_table(spark, root).select("name", "extension", "depth", F.array_join("folders", "/").alias("folders"))


@query("SELECT c_nationkey AS row, c_custkey % 4 AS col, round(avg(c_acctbal)::FLOAT::DOUBLE, 3) AS value FROM customer GROUP BY ALL")
def q_raster_band(spark, d):
    """Written as GeoTIFF and read back by its own tags."""
    import struct

    import numpy as np

    path = f"{scratch(spark, 'band')}.tif"
    cells = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("row"), (F.col("c_custkey") % 4).alias("col")).agg(F.avg("c_acctbal").alias("value"))
    rasters.write_band(cells, path, 10.0, 2263, tags={"n": 1})
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    (n,) = struct.unpack_from("<H", data, 8)
    tags = {tag: (count, place) for tag, _, count, place in (struct.unpack_from("<HHII", data, 10 + 12 * i) for i in range(n))}
    w, h, start = tags[256][1], tags[257][1], tags[273][1]
    grid = np.frombuffer(data, "<f4", w * h, start).reshape(h, w)
    left, top = struct.unpack_from("<6d", data, tags[33922][1])[3:5]
    rows = [(int(round(top / 10)) - 1 - i, int(round(left / 10)) + j, round(float(grid[i, j]), 3)) for i in range(h) for j in range(w) if not np.isnan(grid[i, j])]
    return spark.createDataFrame(rows, "row int, col long, value double")
