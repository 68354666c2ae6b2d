"""Queries over cleaning, normalizers, the catalog, geometry, sources and writers, beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import boxes, columns, geo, nested, text
from quadrat.operators import graph, rows, spatial, timeline
from quadrat.plans import catalog, normalize
from quadrat.registry import query, rnd, t
from quadrat.sources import readers, writers
from quadrat.sources.storage import ensure_checkpoint_dir


def scratch(spark, label: str) -> str:
    """A new path below the shared folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quadrat-{label}-{uuid.uuid4().hex}"


# --- strings, keys, dates

MESSY = "CASE c_custkey % 6 WHEN 0 THEN ' NaN ' WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN '<NA>' ELSE '  ' || c_name || ' ' END"
NUMBERS = "CASE c_custkey % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'abc' WHEN 2 THEN CAST(c_custkey AS STRING) || '.5' ELSE CAST(c_custkey AS STRING) END"
BINS = "CASE c_custkey % 4 WHEN 0 THEN CAST(1000000 + c_custkey AS STRING) || '.0' WHEN 1 THEN CAST(6000000 + c_custkey AS STRING) WHEN 2 THEN '1000000' ELSE ' ' || CAST(3000000 + c_custkey AS STRING) END"


@query(f"""
WITH r AS (SELECT c_custkey, {MESSY} AS a, {NUMBERS} AS n, trim({BINS}) AS b FROM customer), p AS (SELECT *, CASE WHEN lower(trim(a)) IN ('', 'nan', 'none', 'null', '<na>') THEN NULL ELSE trim(a) END AS clean, regexp_replace(b, '\\.0+$', '') AS digits FROM r)
SELECT c_custkey, clean, CASE WHEN isnan(try_cast(n AS DOUBLE)) THEN NULL ELSE try_cast(n AS DOUBLE) END AS number, CASE WHEN regexp_matches(digits, '^[1-5][0-9]{{6}}$') AND digits <> '1000000' THEN digits END AS building,
 CASE WHEN clean IS NULL THEN CAST(c_nationkey AS VARCHAR) ELSE clean || ' ' || c_nationkey END AS address FROM p JOIN (SELECT c_custkey, c_nationkey FROM customer) USING (c_custkey)""")
def q_clean_columns(spark, d):
    c = t(spark, d, "customer").selectExpr("c_custkey", "c_nationkey", f"{MESSY} AS a", f"{NUMBERS} AS n", f"{BINS} AS b")
    return c.select("c_custkey", columns.present(F.col("a")).alias("clean"), columns.number(F.col("n")).alias("number"), columns.building_number(F.col("b"), ["1000000"]).alias("building"), columns.address(F.col("a"), F.col("c_nationkey").cast("string")).alias("address"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS code, CASE WHEN c_nationkey > 20 THEN 'high' WHEN c_nationkey > 10 THEN 'mid' WHEN c_nationkey >= 0 THEN 'low' END AS rule,
 CASE WHEN c_mktsegment LIKE '%MACH%' THEN 'mach' WHEN c_mktsegment LIKE '%BUILD%' THEN 'build' END AS named, CASE WHEN c_custkey % 7 = 5 THEN 'STATEN ISLAND' WHEN c_custkey % 7 = 4 THEN 'QUEENS' WHEN c_custkey % 7 = 3 OR c_nationkey = 3 THEN 'BROOKLYN' WHEN c_custkey % 7 = 2 THEN 'BRONX' WHEN c_custkey % 7 = 1 THEN 'MANHATTAN' END AS borough FROM customer""")
def q_lookup_rules(spark, d):
    c, k = t(spark, d, "customer"), F.col("c_nationkey")
    return c.select("c_custkey", columns.lookup(F.col("c_mktsegment"), {"BUILDING": "b", "MACHINERY": "m"}, F.lit("other")).alias("code"), columns.last_rule_wins([(k >= 0, "low"), (k > 10, "mid"), (k > 20, "high")]).alias("rule"), columns.name_contains(F.col("c_mktsegment"), ["mach", "build"]).alias("named"), columns.borough_of(F.when(k == 3, " brooklyn"), (F.col("c_custkey") % 7).cast("string")).alias("borough"))


@query("""
SELECT p_partkey, 'p_' || printf('%.7f', p_retailprice / 7) || '_' || printf('%.7f', -p_size / 3.0) AS place, split_part('a/' || p_brand || '/' || p_size || '.jpg', '/', 2) AS folder, p_size || '.jpg' AS file,
 trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def q_keys_and_paths(spark, d):
    path = F.concat(F.lit("a/"), "p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".jpg"))
    return t(spark, d, "part").select("p_partkey", columns.coordinate_key("p_", F.col("p_retailprice") / 7, -F.col("p_size") / 3.0).alias("place"), columns.path_part(path, 2).alias("folder"), columns.path_part(path, 1).alias("file"), columns.slug(F.col("p_name")).alias("slug"))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '1900-01-01' ELSE date_trunc('second', o_orderdate) END AS ts FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 2 THEN date_trunc('day', ts) ELSE ts END AS parsed, o_orderkey % 11 = 0 AND o_orderkey % 5 <> 4 AS placeholder,
 CASE WHEN year(ts) BETWEEN 1992 AND 1994 THEN 'early' WHEN year(ts) BETWEEN 1994 AND 1998 THEN 'late' END AS bin, ts >= TIMESTAMP '1993-01-01' AND ts <= TIMESTAMP '1997-06-30' AS inside FROM o""")
def q_dates(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.lit("1900-01-01").cast("timestamp_ntz")).otherwise(F.date_trunc("second", "o_orderdate").cast("timestamp_ntz")).alias("ts"))
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")).when(k == 1, F.date_format("ts", " yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "MM/dd/yyyy")).when(k == 3, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).otherwise("n/a")
    when, flag = columns.not_placeholder_date(columns.parse_dates(s))
    return o.select("o_orderkey", when.alias("parsed"), flag.alias("placeholder"), columns.year_bin(F.year("ts"), [(1992, 1994, "early"), (1994, 1998, "late")]).alias("bin"), columns.day_bounds(F.col("ts"), "1993-01-01", "1997-06-30").alias("inside"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (c_custkey % 100) / 100.0 WHEN 1 THEN 0.95 ELSE 0.5 END AS share FROM customer""")
def q_percent(spark, d):
    k = F.col("c_custkey")
    s = F.when(k % 3 == 0, F.concat((k % 100).cast("string"), F.lit("%"))).when(k % 3 == 1, "Above 95%").otherwise("0.5")
    return t(spark, d, "customer").select("c_custkey", columns.percent(s, F.lit(0.5)).alias("share"))


# --- rows

@query("""
SELECT c_custkey, 'F' AS face, c_acctbal AS score, c_nationkey AS n FROM customer UNION ALL SELECT c_custkey, 'B', c_acctbal * 2, NULL FROM customer UNION ALL SELECT c_custkey, 'L', NULL, NULL FROM customer""")
def q_wide_to_long(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("score_F"), (F.col("c_acctbal") * 2).alias("score_B"), F.col("c_nationkey").alias("n_F"))
    return rows.wide_to_long(c, ["c_custkey"], ["score", "n"], ["F", "B", "L"])


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment FROM customer")
def q_renamed_present(spark, d):
    return rows.present_columns(rows.renamed(t(spark, d, "customer"), {"c_custkey": "id", "c_name": "name", "absent": "x"}), ["id", "name", "absent", "c_mktsegment"])


@query("SELECT k, count(*) AS n FROM (SELECT DISTINCT CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey END AS k, CASE WHEN c_nationkey % 4 = 0 THEN c_custkey END AS x FROM customer) GROUP BY k")
def q_distinct_keep_nulls(spark, d):
    c = t(spark, d, "customer").select(F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")).alias("k"))
    return rows.distinct_keep_nulls(c, ["k"]).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM events e WHERE event_type <> 'error' OR NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type <> 'error') GROUP BY ALL")
def q_without_sentinels(spark, d):
    return rows.without_sentinels(t(spark, d, "events"), ["user_id"], F.col("event_type") == "error").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, count(o) AS n_matched, round(count(o) / count(*), 6) AS match_rate FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey")
def q_match_report(spark, d):
    return rows.match_report(t(spark, d, "customer"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).withColumn("match_rate", rnd("match_rate"))


@query("SELECT c_custkey, n_name, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q_many_to_one(spark, d):
    n = t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return rows.join_many_to_one(t(spark, d, "customer"), n, ["c_nationkey"]).select("c_custkey", "n_name", "c_acctbal")


@query("SELECT true AS is_prefix, (SELECT count(*) FROM nation WHERE n_nationkey < 20) AS n_compared, (SELECT count(*) FROM nation WHERE n_nationkey < 20) AS n_common")
def q_ordered_prefix(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    return rows.ordered_prefix(n.where("n_nationkey < 20"), n, "n_nationkey", "n_name")


# --- normalizers

@query("""
WITH o AS (SELECT o_orderkey, o_custkey, date_trunc('second', o_orderdate) AS ts, o_totalprice FROM orders),
a AS (SELECT 'dob_now' AS source, 'J' || o_orderkey AS permit_id, upper(CASE o_custkey % 2 WHEN 0 THEN 'Bronx' ELSE 'queens' END) AS borough, ts AS issue_date, NULL::TIMESTAMP AS expiration_date, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'both' WHEN o_orderkey % 2 = 0 THEN 'scaffold' WHEN o_orderkey % 3 = 0 THEN 'shed' END AS scaffold_type, o_custkey || ' MAIN ST' AS address, o_totalprice AS initial_cost, NULL AS permit_subtype FROM o),
b AS (SELECT 'bis', o_orderkey || '-01', 'MANHATTAN', date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 1 YEAR, CASE o_orderkey % 4 WHEN 0 THEN 'shed' WHEN 1 THEN 'shed' WHEN 2 THEN 'scaffold' END, NULL, NULL, CASE o_orderkey % 4 WHEN 0 THEN 'SH' WHEN 1 THEN 'SD' WHEN 2 THEN 'SF' END FROM o WHERE day(ts) <= 28)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def q_permits(spark, d):
    o = t(spark, d, "orders").withColumn("ts", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz"))
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    flags = o.select(F.concat(F.lit("J"), s(k)).alias("job_filing_number"), F.when(F.col("o_custkey") % 2 == 0, " Bronx").otherwise("queens").alias("borough"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("first_permit_date"), F.when(k % 2 == 0, "1").otherwise("0").alias("scaffold"), F.when(k % 3 == 0, " 1").otherwise("0").alias("shed"), s(F.col("o_custkey")).alias("house_no"), F.lit("MAIN ST").alias("street_name"), s(F.col("o_totalprice")).alias("initial_cost"))
    kind = F.when(k % 4 == 0, "sh").when(k % 4 == 1, "SD").when(k % 4 == 2, "SF").otherwise("")
    subtypes = o.where(F.dayofmonth("ts") <= 28).select(s(k).alias("job__"), F.lit("01").alias("permit_sequence__"), F.lit("Manhattan").alias("borough"), F.date_format("ts", "MM/dd/yyyy").alias("issuance_date"), F.date_format(F.add_months(F.to_date("ts"), 12), "MM/dd/yyyy").alias("expiration_date"), kind.alias("permit_subtype"), F.lit("none").alias("house__"))
    return normalize.all_permits(flags, subtypes).select("source", "permit_id", "borough", "issue_date", "expiration_date", "scaffold_type", "address", "initial_cost", "permit_subtype")


@query("""
WITH r AS (SELECT user_id::VARCHAR AS camis, CASE WHEN event_id % 9 = 0 THEN NULL ELSE date_trunc('day', ts) END AS inspection_date, event_id % 9 = 0 AS ph, event_type AS kind, event_id % 4 = 0 AS crit, lpad((event_id % 97)::VARCHAR, 2, '0') AS code FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY camis, inspection_date, kind ORDER BY CASE WHEN crit THEN 0 ELSE 1 END, code) AS rn FROM r)
SELECT camis, inspection_date, ph AS is_placeholder_inspection, kind AS inspection_type, CASE WHEN crit THEN 'Critical' ELSE 'Not Critical' END AS critical_flag, code AS violation_code, 'BRONX' AS borough FROM o WHERE rn = 1""")
def q_inspections(spark, d):
    k = F.col("event_id")
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("camis"), F.when(k % 9 == 0, "01/01/1900").otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("inspection_date"), F.col("event_type").alias("inspection_type"), F.when(k % 4 == 0, "Critical").otherwise("Not Critical").alias("critical_flag"), F.lpad((k % 97).cast("string"), 2, "0").alias("violation_code"), F.lit("2").alias("boro"))
    return normalize.inspections(e, {"2": "BRONX"}).select("camis", "inspection_date", "is_placeholder_inspection", "inspection_type", "critical_flag", "violation_code", "borough")


@query("""
WITH r AS (SELECT s_suppkey, s_name AS name, 'b' || (s_nationkey % 5) AS bbl, CASE s_suppkey % 2 WHEN 0 THEN 'Sidewalk Cafe' ELSE 'Food-Cart' END AS kind FROM supplier), k AS (SELECT *, bbl || '_' || CASE kind WHEN 'Sidewalk Cafe' THEN 'sidewalk_cafe' ELSE 'food_cart' END || '_' || '40.5000000_-73.2500000' AS base FROM r)
SELECT name, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '_' || (row_number() OVER (PARTITION BY base ORDER BY name) - 1) ELSE base END AS uid FROM k""")
def q_licences(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_name").alias("business_legal_name"), F.lit("").alias("assumed_name_s"), F.concat(F.lit("b"), (F.col("s_nationkey") % 5).cast("string")).alias("bbl"), F.when(F.col("s_suppkey") % 2 == 0, "Sidewalk Cafe").otherwise("Food-Cart").alias("license_type"), F.lit("40.5").alias("latitude"), F.lit("-73.25").alias("longitude"))
    return normalize.licences(s).select("name", "uid")


@query("SELECT 'u' || c_custkey AS uid, c_mktsegment AS borough, 'Name ' || c_nationkey AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS latitude, NULL::VARCHAR AS \"group\" FROM customer")
def q_facilities(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("uid"), F.concat(F.lit("NAME "), F.col("c_nationkey").cast("string")).alias("facname"), F.lower("c_mktsegment").alias("boro"), F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("latitude"))
    return normalize.facilities(c).select("uid", "borough", "name", "latitude", "group")


@query("""
SELECT s_suppkey::VARCHAR AS station_id, s_nationkey % 2 = 0 AS entry_allowed, 'subway_' || printf('%.7f', s_acctbal / 1000) || '_' || printf('%.7f', -s_nationkey / 8.0) AS uid FROM supplier WHERE s_suppkey % 3 = 0""")
def q_entrances(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("station_id"), F.when(F.col("s_nationkey") % 2 == 0, "Yes").otherwise("NO").alias("entry_allowed"), F.when(F.col("s_suppkey") % 3 == 0, "A C").otherwise("AC 1").alias("daytime_routes"), (F.col("s_acctbal") / 1000).cast("string").alias("entrance_latitude"), (-F.col("s_nationkey") / 8.0).cast("string").alias("entrance_longitude"))
    return normalize.entrances(s, ["c"]).select("station_id", "entry_allowed", "uid")


# --- catalog

FACES = """
WITH f AS (SELECT 'd' || (event_id % 3) AS dataset, user_id AS g, event_id AS r, substr('FRBLUD', (event_id % 6 + 1)::INTEGER, 1) AS face, event_id % 1000 AS length, value FROM events),
m AS (SELECT event_id, value FROM events WHERE event_id % 4 <> 0), w AS (SELECT event_id, ts, value FROM events WHERE event_id % 5 <> 0),
b AS (SELECT 'R' || r AS recording_id, dataset, face, length, coalesce(m.value, w.value + 1) AS latitude, w.event_id IS NOT NULL AS catalog_hit, coalesce(year(w.ts), 2030)::INTEGER AS year,
 CASE face WHEN 'F' THEN 0 WHEN 'R' THEN 90 WHEN 'B' THEN 180 WHEN 'L' THEN 270 END + CASE WHEN w.event_id IS NOT NULL THEN r % 90 END AS bearing, w.ts AS recorded, r FROM f LEFT JOIN m ON m.event_id = r LEFT JOIN w ON w.event_id = r)"""


def face_inputs(spark, d):
    e, rec = t(spark, d, "events"), F.concat(F.lit("R"), F.col("event_id").cast("string"))
    place = [F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("dataset"), F.col("user_id").cast("string").alias("group"), rec.alias("recording_dir")]
    images = e.select(*place, F.substring(F.lit("FRBLUD"), (F.col("event_id") % 6 + 1).cast("int"), F.lit(1)).alias("face"), (F.col("event_id") % 1000).alias("length"), (F.col("event_id") % 7 == 0).alias("has_depth"))
    label = F.struct(rec.alias("imageId"), F.concat_ws(",", F.lit("-74.0"), F.col("value").cast("string")).alias("label"))
    manifests = e.where("event_id % 4 <> 0").select(*place, label.alias("manifest"), F.lit(True).alias("manifest_ok"))
    recordings = e.where("event_id % 5 <> 0").select(rec.alias("imageId"), (F.col("value") + 1).alias("lat"), F.lit(-73.0).alias("lon"), F.col("ts").alias("recordedAt"), F.lit(None).cast("int").alias("year"), (F.col("event_id") % 90).cast("double").alias("recorderDirection"))
    return images, manifests, recordings


@query(FACES + " SELECT recording_id, dataset, face, round(latitude, 6) AS latitude, catalog_hit, year, bearing::DOUBLE AS bearing, recording_id || '_' || face AS sample_id, length < 100 AS small_file FROM b")
def q_catalog_faces(spark, d):
    f = catalog.build_faces(*face_inputs(spark, d), 2030, 100)
    return f.select("recording_id", "dataset", "face", rnd("latitude").alias("latitude"), "catalog_hit", "year", F.col("bearing").cast("double").alias("bearing"), "sample_id", "small_file")


@query(FACES + " SELECT recording_id, round(coalesce(latitude, n.value + 2), 6) AS latitude, n.event_id IS NOT NULL AS catalog_hit, n.ts AS \"recordedAt\" FROM b LEFT JOIN (SELECT * FROM events WHERE event_id % 3 <> 0) n ON n.event_id = r")
def q_catalog_rejoin(spark, d):
    images, manifests, recordings = face_inputs(spark, d)
    again = t(spark, d, "events").where("event_id % 3 <> 0").select(F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("imageId"), (F.col("value") + 2).alias("lat"), F.lit(-73.0).alias("lon"), F.col("ts").alias("recordedAt"), F.lit(1.0).alias("recorderDirection"))
    return catalog.rejoin(catalog.build_faces(images, manifests, recordings, 2030), again).select("recording_id", rnd("latitude").alias("latitude"), "catalog_hit", "recordedAt")


@query("""
WITH g AS (SELECT user_id, event_type, avg(value) AS lat, min(ts) AS first, count(*) AS n, count(*) FILTER (WHERE event_id % 7 = 0) AS nd, sum(event_id)::BIGINT AS b FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS rn FROM g)
SELECT user_id AS recording_id, event_type AS dataset, round(lat, 6) AS latitude, first AS "recordedAt", n AS n_faces, nd AS n_depth_faces, b AS bytes_total, nd > 0 AS has_depth, year(first)::INTEGER AS year, month(first)::INTEGER AS month FROM r WHERE rn = 1""")
def q_recording_index(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("dataset"), F.lit("g").alias("group"), F.col("value").alias("latitude"), F.col("value").alias("longitude"), F.col("ts").alias("recordedAt"), (F.col("event_id") % 7 == 0).alias("has_depth"), F.col("event_id").alias("length"))
    return catalog.recording_index(e).drop("group", "longitude").withColumn("latitude", rnd("latitude"))


# --- geometry

def square(x, y, half: float):
    corner = lambda a, b: F.struct((x + a * half).cast("double").alias("x"), (y + b * half).cast("double").alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


@query("""
WITH u AS (SELECT c_custkey, c_custkey % 40 AS bin, c_acctbal AS x, (c_custkey % 50) * 20.0 AS y, c_custkey % 9 = 0 AS nowhere FROM customer), b AS (SELECT s_suppkey AS bin, s_acctbal AS bx, s_nationkey * 40.0 AS b_y FROM supplier WHERE s_suppkey % 2 = 0),
e AS (SELECT c_custkey FROM u JOIN b USING (bin)), j AS (SELECT u.c_custkey, b.bin, sqrt(power(greatest(abs(x - bx) - 10, 0), 2) + power(greatest(abs(y - b_y) - 10, 0), 2)) AS dd FROM u, b WHERE NOT nowhere AND c_custkey NOT IN (SELECT c_custkey FROM e)),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(dd, 9), bin) AS rn FROM j WHERE dd <= 60) WHERE rn = 1)
SELECT u.c_custkey, CASE WHEN e.c_custkey IS NOT NULL THEN 'bin' WHEN n.c_custkey IS NOT NULL THEN 'nearest' WHEN NOT nowhere THEN 'point' ELSE 'none' END AS geom_source, CASE WHEN e.c_custkey IS NOT NULL THEN u.bin ELSE n.bin END AS matched_bin, round(CASE WHEN e.c_custkey IS NOT NULL THEN 0 ELSE n.dd END, 6) AS match_dist
FROM u LEFT JOIN e USING (c_custkey) LEFT JOIN n ON n.c_custkey = u.c_custkey""")
def q_geometry_cascade(spark, d):
    k = F.col("c_custkey")
    u = t(spark, d, "customer").select("c_custkey", (k % 40).alias("bin"), F.when(k % 9 != 0, F.col("c_acctbal")).alias("x"), F.when(k % 9 != 0, (k % 50) * 20.0).alias("y"))
    b = t(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("bin"), square(F.col("s_acctbal"), F.col("s_nationkey") * 40.0, 10.0).alias("ring"))
    return spatial.geometry_cascade(u, b, "c_custkey", "bin", "ring", 100.0, 60.0).select("c_custkey", "geom_source", "matched_bin", rnd("match_dist").alias("match_dist"))


RADIUS, SERIES = geo.krueger()
E_, N_, SCALE, AT_ORIGIN = geo.conic(*geo.LONG_ISLAND[:2])
THIRD = geo.FLAT / (2 - geo.FLAT)
ECC = 2 * THIRD**0.5 / (1 + THIRD)


@query(f"""
WITH c AS (SELECT c_custkey, 40.5 + c_acctbal / 20000 AS la, -74.2 + c_nationkey / 50.0::DOUBLE AS lo FROM customer), d AS (SELECT c_custkey, la, lo, radians(lo + 75) AS d, sin(radians(la)) AS s FROM c),
k AS (SELECT *, sinh(atanh(s) - {ECC!r}::DOUBLE * atanh({ECC!r}::DOUBLE * s)) AS t FROM d), x AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM k),
p AS (SELECT *, {SCALE!r}::DOUBLE * power(tan(pi() / 4 - radians(la) / 2) / power((1 - {E_!r}::DOUBLE * s) / (1 + {E_!r}::DOUBLE * s), {E_ / 2!r}::DOUBLE), {N_!r}::DOUBLE) AS rho, {N_!r}::DOUBLE * radians(lo + 74) AS th FROM x)
SELECT c_custkey, round(500000 + 0.9996::DOUBLE * {RADIUS!r}::DOUBLE * (eta + {' + '.join(f'{a!r}::DOUBLE * cos({2 * j + 2} * xi) * sinh({2 * j + 2} * eta)' for j, a in enumerate(SERIES))}), 3) AS utm_x,
 round(0.9996::DOUBLE * {RADIUS!r}::DOUBLE * (xi + {' + '.join(f'{a!r}::DOUBLE * sin({2 * j + 2} * xi) * cosh({2 * j + 2} * eta)' for j, a in enumerate(SERIES))}), 3) AS utm_y,
 round((300000 + rho * sin(th)) / (1200.0::DOUBLE / 3937), 3) AS plane_x, round(({AT_ORIGIN!r}::DOUBLE - rho * cos(th)) / (1200.0::DOUBLE / 3937), 3) AS plane_y FROM p""")
def q_projections(spark, d):
    la, lo = 40.5 + F.col("c_acctbal") / 20000, -74.2 + F.col("c_nationkey") / 50.0
    (ux, uy), (px, py) = geo.utm_xy(la, lo), geo.state_plane_ft(la, lo)
    return t(spark, d, "customer").select("c_custkey", *[rnd(c, 3).alias(n) for c, n in ((ux, "utm_x"), (uy, "utm_y"), (px, "plane_x"), (py, "plane_y"))])


RAYS = """
WITH c AS (SELECT c_custkey, c_nationkey % 2 AS own, round(c_acctbal / 20, 1) + 0.03 AS x, (c_custkey % 100) * 5.0 + 0.01 AS y, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 WHEN 3 THEN 270 END AS b FROM customer),
p AS (SELECT c.*, s, x + CASE b WHEN 90 THEN s WHEN 270 THEN -s ELSE 0 END * 3.0 AS px, y + CASE b WHEN 0 THEN s WHEN 180 THEN -s ELSE 0 END * 3.0 AS py FROM c, range(1, 11) r(s) WHERE b IS NOT NULL), z AS (SELECT s_suppkey % 2 AS k, s_acctbal / 20 AS zx, s_suppkey * 5.0 AS zy FROM supplier)"""


def ray_inputs(spark, d):
    k = F.col("c_custkey")
    face = F.when(k % 5 < 4, (k % 5) * 90.0)
    c = t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 2).alias("own"), (F.round(F.col("c_acctbal") / 20, 1) + 0.03).alias("x"), ((k % 100) * 5.0 + 0.01).alias("y"), face.alias("b"))
    z = t(spark, d, "supplier").select((F.col("s_suppkey") % 2).alias("k"), square(F.col("s_acctbal") / 20, F.col("s_suppkey") * 5.0, 8.0).alias("ring"))
    return c, z


@query(RAYS + " SELECT c_custkey, count(DISTINCT s) AS hits, min(s) * 3.0::DOUBLE AS first_hit FROM p JOIN z ON abs(px - zx) < 8 AND abs(py - zy) < 8 GROUP BY c_custkey")
def q_facing(spark, d):
    c, z = ray_inputs(spark, d)
    return spatial.facing(c, z, "c_custkey", "b", "ring", 30.0, 10, 25.0).select("c_custkey", "hits", "first_hit")


@query(RAYS + " SELECT c_custkey, count(DISTINCT s) AS hits, round(least(1, count(DISTINCT s) / 10 * power(1 - min(s) * 3 / 40, 3)), 6) AS confidence FROM p JOIN z ON z.k = own AND abs(px - zx) < 8 AND abs(py - zy) < 8 GROUP BY c_custkey")
def q_facing_own(spark, d):
    c, z = ray_inputs(spark, d)
    f = spatial.facing(c, z, "c_custkey", "b", "ring", 30.0, 10, 25.0, own=("own", "k"))
    return f.select("c_custkey", "hits", rnd(geo.facing_confidence(F.col("hits"), F.lit(10), F.col("first_hit"), 40.0)).alias("confidence"))


@query("""
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey % 10 END AS own, round(c_acctbal / 20, 1) + 0.03 AS x, (c_custkey % 100) * 5.0 + 0.01 AS y, (c_custkey % 100) * 5.0 + 40.01 AS ty FROM customer), z AS (SELECT s_suppkey AS bk, s_suppkey % 10 AS k, s_acctbal / 20 AS zx, s_suppkey * 5.0 AS zy FROM supplier)
SELECT c_custkey FROM l WHERE own IS NULL OR NOT EXISTS (SELECT 1 FROM z WHERE k <> own AND abs(x - zx) < 3 AND y < zy + 3 AND ty > zy - 3)""")
def q_not_occluded(spark, d):
    k = F.col("c_custkey")
    lines = t(spark, d, "customer").select("c_custkey", F.when(k % 6 != 0, F.col("c_nationkey") % 10).alias("own"), (F.round(F.col("c_acctbal") / 20, 1) + 0.03).alias("x"), ((k % 100) * 5.0 + 0.01).alias("y")).select("*", F.col("x").alias("tx"), (F.col("y") + 40.0).alias("ty"))
    z = t(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("k"), square(F.col("s_acctbal") / 20, F.col("s_suppkey") * 5.0, 3.0).alias("ring"))
    return spatial.not_occluded(lines, z, "c_custkey", "own", "k", "ring", 25.0).select("c_custkey")


ZONES = "WITH p AS (SELECT c_custkey, c_acctbal AS x, c_custkey * 10.0 AS y, c_acctbal AS v FROM customer), z AS (SELECT n_name AS zone, n_nationkey * 400.0 + 250 AS zx, n_nationkey * 300.0 + 250 AS zy FROM nation)"


def zone_inputs(spark, d):
    p = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 10.0).alias("y"))
    z = t(spark, d, "nation").select(F.col("n_name").alias("zone"), square(F.col("n_nationkey") * 400.0 + 250, F.col("n_nationkey") * 300.0 + 250, 400.0).alias("ring"))
    return p, z


@query(ZONES + " SELECT c_custkey, min(zone) AS zone FROM p LEFT JOIN z ON x >= zx - 400 AND x < zx + 400 AND y >= zy - 400 AND y < zy + 400 GROUP BY c_custkey")
def q_zone_assign(spark, d):
    p, z = zone_inputs(spark, d)
    return spatial.zone_assign(p, z, "c_custkey", "zone", "ring", 500.0).select("c_custkey", "zone")


@query(ZONES + " SELECT zone, count(c_custkey) AS n, round(avg(x), 4) AS mean FROM z LEFT JOIN p ON x >= zx - 400 AND x < zx + 400 AND y >= zy - 400 AND y < zy + 400 GROUP BY zone")
def q_zone_aggregate(spark, d):
    p, z = zone_inputs(spark, d)
    g = spatial.zone_aggregate(p, z, "zone", "ring", 500.0, F.count("*").alias("n"), rnd(F.avg("x"), 4).alias("mean"), keep_empty=True)
    return g.withColumn("n", F.coalesce("n", F.lit(0)))


@query("""
WITH a AS (SELECT s_nationkey AS r, s_suppkey % 4 AS c, avg(s_acctbal) AS v FROM supplier GROUP BY ALL), b AS (SELECT c_nationkey AS r, c_custkey % 5 AS c, avg(c_acctbal) AS v FROM customer GROUP BY ALL)
SELECT r AS row, c AS col, round(a.v - b.v, 4) AS diff, round(abs(a.v - b.v), 4) AS absdiff, round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN greatest(a.v, b.v) END, 4) AS most FROM a FULL JOIN b USING (r, c)""")
def q_combine_rasters(spark, d):
    a = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("row"), (F.col("s_suppkey") % 4).alias("col")).agg(F.avg("s_acctbal").alias("value"))
    b = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("row"), (F.col("c_custkey") % 5).alias("col")).agg(F.avg("c_acctbal").alias("value"))
    one = lambda how, name: spatial.combine_rasters(a, b, how).select("row", "col", rnd("value", 4).alias(name))
    return one("diff", "diff").join(one("absdiff", "absdiff"), ["row", "col"]).join(one("max", "most"), ["row", "col"])


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ((event_id % 7) * 256 + event_id % 256)::INTEGER END AS code, substr('FRBL', (((event_id * 13) % 360 + 45)::INTEGER // 90) % 4 + 1, 1) AS face,
 least(3000, greatest(0, (event_id % 5) * 700 + 10))::INTEGER AS x0 FROM events WHERE event_id % 256 <> 0 AND (event_id * 13) % 90 <> 45""")
def q_depth_faces_boxes(spark, d):
    k = F.col("event_id")
    e = t(spark, d, "events").where("event_id % 256 <> 0 and (event_id * 13) % 90 <> 45")
    code = geo.depth_code(F.when(k % 7 == 0, 0).otherwise(k % 7), F.when(k % 7 == 0, 0).otherwise(k % 256))
    box = geo.tile_box(F.lit(10), F.lit(5), F.lit(20), F.lit(20), (k % 5) * 700, F.lit(0), 3000, 2000)
    return e.select("event_id", code.alias("code"), geo.face_for_bearing(((k * 13) % 360).cast("double"), F.lit(0.0)).alias("face"), box["x0"].alias("x0"))


@query("""
WITH b AS (SELECT p_partkey, p_size * 1.0::DOUBLE AS x0, p_size * 1.0::DOUBLE + 40 AS x1 FROM part)
SELECT p_partkey, round(x0 + 40 * 0.25::DOUBLE, 6) AS face_x0, 40.0::DOUBLE AS face_y1, 90.0::DOUBLE AS plate_y0, (x0 + x1) / 2 BETWEEN 20 AND 50 AS inside, p_partkey % 2 = 0 AND p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS wanted FROM b""")
def q_derived_boxes(spark, d):
    k = F.col("p_partkey")
    box = F.struct((F.col("p_size") * 1.0).alias("x0"), F.lit(10.0).alias("y0"), (F.col("p_size") * 1.0 + 40).alias("x1"), F.lit(110.0).alias("y1"))
    have = F.array_compact(F.array(F.when(k % 2 == 0, "two"), F.when(k % 3 == 0, "three"), F.when(k % 5 == 0, "five")))
    return t(spark, d, "part").select("p_partkey", rnd(boxes.upper_part(box, 0.3, 0.25)["x0"]).alias("face_x0"), rnd(boxes.upper_part(box, 0.3, 0.25)["y1"]).alias("face_y1"), rnd(boxes.lower_part(box, 0.2)["y0"]).alias("plate_y0"), boxes.centre_in(box, 20, 0, 50, 200).alias("inside"), boxes.features_match(have, "two & three | five").alias("wanted"))


@query("""
SELECT event_id, label, x FROM (SELECT event_id, 'car' AS label, value AS x FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 'bus', value + 1 FROM events WHERE event_id % 3 = 2 UNION ALL SELECT event_id, 'none', NULL FROM events WHERE event_id % 3 = 0)""")
def q_detections(spark, d):
    item = lambda name, add: F.struct(F.lit(name).alias("label"), (F.col("value") + add).alias("x"))
    k = F.col("event_id") % 3
    j = F.when(k == 0, "[]").when(k == 1, F.to_json(F.array(item("car", 0)))).otherwise(F.to_json(F.array(item("car", 0), item("bus", 1))))
    return boxes.detections(t(spark, d, "events").withColumn("j", j), "j", ["event_id"], "label:string,x:double", "none").select("event_id", "label", "x")


# --- nested values and text

@query("""
SELECT conv_id, turn, regexp_matches(role, 'user|system') AS listed, len(list_distinct(list_filter([role, 'none', '', text[1:3]], lambda x: trim(x) <> '' AND lower(trim(x)) NOT IN ('none', 'null'))))::INTEGER AS n_items FROM conversations""")
def q_string_lists(spark, d):
    c = t(spark, d, "conversations").withColumn("j", F.to_json(F.array("role", F.lit("none"), F.lit(""), F.substring("text", 1, 3))))
    items = nested.string_list(F.col("j"))
    return c.select("conv_id", "turn", (F.array_contains(items, "user") | F.array_contains(items, "system")).alias("listed"), F.size(F.array_distinct(items)).alias("n_items"))


@query("""
WITH g AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS kept, count(*) AS n FROM g WHERE before IS DISTINCT FROM role GROUP BY conv_id""")
def q_collapse_repeats(spark, d):
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    kept = nested.collapse_repeats(F.col("r"))
    return c.select("conv_id", F.array_join(kept, "|").alias("kept"), F.size(kept).cast("long").alias("n"))


@query("""
WITH s AS (SELECT conv_id, turn, turn % 4 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 3 THEN NULL ELSE 'dimension' END AS ingredient_type, CASE WHEN k <> 3 THEN i END::INTEGER AS ingredient_index FROM s, range(2) r(i) WHERE k <> 3 OR i = 0 UNION ALL SELECT conv_id, turn, 'verdict', 0 FROM s WHERE k = 1""")
def q_ingredients(spark, d):
    k = F.col("turn") % 4
    two = F.array(F.struct(F.lit("x").alias("name")), F.struct(F.lit("y").alias("name")))
    a = F.when(k == 3, "{}").when(k == 1, F.to_json(F.struct(two.alias("dimensions"), F.array(F.struct(F.lit("A").alias("label"))).alias("verdicts")))).otherwise(F.to_json(F.struct(two.alias("dimensions"))))
    c = t(spark, d, "conversations").withColumn("a", a)
    return nested.ingredient_rows(c, "a", ["conv_id", "turn"], {"dimensions": "dimension", "verdicts": "verdict"}).select("conv_id", "turn", "ingredient_type", "ingredient_index")


@query("""
SELECT conv_id, turn, '{"role": "' || role || '"}' AS object, (turn % 3)::INTEGER AS n_located FROM conversations""")
def q_last_object(spark, d):
    c = t(spark, d, "conversations")
    j = F.concat(F.lit('noise {"role": "'), "role", F.lit('"} tail'))
    span = lambda m: F.struct(F.lit("x").alias("text"), F.lit(m).alias("method"))
    spans = F.slice(F.array(span("exact"), span("whitespace"), span("none")), F.lit(1), (F.col("turn") % 3).cast("int"))
    return c.select("conv_id", "turn", nested.last_object(j).alias("object"), nested.located(F.concat(spans, F.array(span("none"), span(None)))).alias("n_located"))


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN 'I say NO' WHEN 2 THEN 'true' ELSE 'maybe' END AS a, c_mktsegment AS s FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS yes, CASE WHEN c_custkey % 3 = 0 THEN 'why ' || s END AS reasoning, s AS answer, CASE WHEN s = 'BUILDING' THEN 'Building' ELSE 'other' END AS word, lower(s) || ' of platform' AS one_space, CASE s WHEN 'BUILDING' THEN 'building|platform' ELSE 'platform|' || lower(s) END AS key_sorted FROM c""")
def q_answers(spark, d):
    c, k, s = t(spark, d, "customer"), F.col("c_custkey"), F.col("c_mktsegment")
    a = F.when(k % 4 == 0, "Yes, it is").when(k % 4 == 1, "I say NO").when(k % 4 == 2, "true").otherwise("maybe")
    reasoning, answer = text.split_reasoning(F.when(k % 3 == 0, F.concat(F.lit("<think> why "), s, F.lit(" </think> "), s)).otherwise(s))
    spaced = F.concat(F.lower(s), F.lit("  of \n platform"))
    key = F.array_join(F.array_sort(F.split(text.word_set_key(spaced), " ")), "|")
    fixed = F.when(s == "BUILDING", "building|platform").otherwise(F.concat(F.lit("platform|"), F.lower(s)))
    return c.select("c_custkey", text.yes_no(a).alias("yes"), reasoning.alias("reasoning"), answer.alias("answer"), text.vocabulary(s, ["Building"]).alias("word"), text.one_space(spaced).alias("one_space"), F.when(F.array_sort(F.split(fixed, r"\|")) == F.array_sort(F.split(key, r"\|")), fixed).otherwise(key).alias("key_sorted"))


@query("""
SELECT s_suppkey, 'n' || lpad((s_suppkey % 5)::VARCHAR, 2, '0') || ',n' || lpad((s_suppkey % 5 + 1)::VARCHAR, 2, '0') || ',m9' AS hosts, (s_suppkey % 3 + 4)::INTEGER AS a100, 2::INTEGER AS untyped FROM supplier""")
def q_hosts_and_resources(spark, d):
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hosts = text.host_list(F.concat(F.lit("n["), two(k % 5), F.lit("-"), two(k % 5 + 1), F.lit("],m9")))
    counts = text.resource_counts(F.concat(F.lit("gpu:a100:"), (k % 3).cast("string"), F.lit(",gpu:2,cpu:9,gpu:a100:4")))
    return t(spark, d, "supplier").select("s_suppkey", F.array_join(hosts, ",").alias("hosts"), counts["a100"].alias("a100"), counts["untyped"].alias("untyped"))


# --- timelines

@query("""
WITH r AS (SELECT event_id, user_id, ts, value, lag(ts) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, coalesce(abs(value - pv) / 100 * pi() / 180 * 6371000, 0) AS dd, CASE WHEN epoch_us(ts) - epoch_us(pt) > 14400000000 OR abs(value - pv) / 100 * pi() / 180 * 6371000 > 60000 THEN 1 ELSE 0 END AS nw FROM r)
SELECT event_id, user_id, round(dd, 3) AS dist_m, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS pass_id FROM s""")
def q_passes(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"), "ts", (F.col("value") / 100).alias("lat"), F.lit(0.0).alias("lon"), F.lit(5.0).alias("yaw"))
    # ties in time are told apart by a microsecond less than any pause
    e = e.withColumn("ts", F.timestamp_micros(F.col("u")))
    p = timeline.passes(e, ["user_id"], "ts", "lat", "lon", "yaw", 14400, 60000.0, 90.0)
    return p.select("event_id", "user_id", rnd("dist_m", 3).alias("dist_m"), "pass_id")


@query("""
SELECT o_orderkey, CASE WHEN n <= 0 THEN 0 ELSE (SELECT count(*) FROM range(0, n, 20) r(s) WHERE s = 0 OR least(n, s + 30) - s >= 12) END AS n_windows FROM (SELECT o_orderkey, (o_orderkey % 200)::BIGINT AS n FROM orders)""")
def q_chunk_bounds(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.size(timeline.chunk_bounds((F.col("o_orderkey") % 200).cast("int"), 30, 10, 12)).cast("long").alias("n_windows"))


@query("""
WITH v AS (SELECT user_id, (event_id % 30)::INTEGER AS layer, max(value) AS v FROM events GROUP BY ALL), u AS (SELECT *, max(layer) FILTER (WHERE v < 40) OVER (PARTITION BY user_id) AS under FROM v)
SELECT user_id, min(layer) FILTER (WHERE v >= 40) AS first_layer, min(layer) FILTER (WHERE v >= 40 AND (under IS NULL OR layer > under)) AS sustained_layer FROM u GROUP BY user_id""")
def q_first_crossing(spark, d):
    v = t(spark, d, "events").groupBy("user_id", (F.col("event_id") % 30).cast("int").alias("layer")).agg(F.max("value").alias("v"))
    return timeline.first_crossing(v, ["user_id"], "layer", "v", 40)


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, value AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, 0.0::DOUBLE AS run, true AS keep FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN f.run + e.step >= 120 THEN 0.0 ELSE f.run + e.step END, f.run + e.step >= 120 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id FROM f WHERE keep""")
def q_thinned(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.col("value").alias("step"))
    return timeline.thin_by_distance(e, ["user_id"], "event_id", "step", 120.0).select("user_id", "event_id")


# --- graphs

@query("""
WITH p AS (SELECT c_custkey, c_acctbal / 10 AS x, (c_custkey % 100) * 1.0 AS y, ((c_custkey * 7) % 360)::DOUBLE AS h FROM customer), e AS (SELECT s_suppkey AS k, s_acctbal / 10 AS ax, (s_suppkey % 100) * 1.0 AS ay FROM supplier),
j AS (SELECT c_custkey, k, sqrt(power(x - greatest(ax, least(ax + 30, x)), 2) + power(y - ay, 2)) AS dd, least(least((abs(h - 90))::DOUBLE % 360, 360 - (abs(h - 90))::DOUBLE % 360), least((abs(h - 270))::DOUBLE % 360, 360 - (abs(h - 270))::DOUBLE % 360)) AS turn FROM p, e)
SELECT c_custkey, k AS edge, round(dd, 6) AS dist, round(dd + 0.1 * turn, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(dd + 0.1 * turn, 9), dd, k) AS rn FROM j WHERE dd <= 25) WHERE rn = 1""")
def q_snap_to_edges(spark, d):
    k = F.col("c_custkey")
    p = t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 10).alias("x"), ((k % 100) * 1.0).alias("y"), ((k * 7) % 360).cast("double").alias("h"))
    s = F.col("s_suppkey")
    e = t(spark, d, "supplier").select(s.alias("edge"), (F.col("s_acctbal") / 10).alias("ax"), ((s % 100) * 1.0).alias("ay"), (F.col("s_acctbal") / 10 + 30).alias("bx"), ((s % 100) * 1.0).alias("by"))
    return graph.snap_to_edges(p, e, "c_custkey", "h", "edge", 50.0, 25.0, 0.1).select("c_custkey", "edge", rnd("dist").alias("dist"), rnd("score").alias("score"))


@query("""
WITH c AS (SELECT DISTINCT c_nationkey AS hq, (c_custkey % 20)::BIGINT AS hr FROM customer WHERE c_custkey % 3 = 0)
SELECT a.hq::BIGINT AS hq, a.hr, count(*) AS n FROM c a JOIN c b ON (b.hq - a.hq, b.hr - a.hr) IN ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)) GROUP BY ALL""")
def q_hex_neighbours(spark, d):
    c = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").cast("long").alias("hq"), (F.col("c_custkey") % 20).cast("long").alias("hr"))
    return graph.hex_neighbours(c).groupBy("hq", "hr").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT o_custkey AS id, o_orderkey AS dst, (o_orderkey * 17 % 360)::DOUBLE AS b, round(o_totalprice, 2) AS dm FROM orders), f AS (SELECT * FROM (VALUES ('F', 0), ('R', 90), ('B', 180), ('L', 270)) v(face, a)),
j AS (SELECT id, face, dst, dm, least(abs(b - (id % 360 + a) % 360), 360 - abs(b - (id % 360 + a) % 360))::DOUBLE AS off FROM e, f)
SELECT id, face, dst, off FROM (SELECT *, row_number() OVER (PARTITION BY id, face ORDER BY off, dm, dst) AS rn FROM j WHERE off <= 45) WHERE rn = 1""")
def q_face_moves(spark, d):
    o = t(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), rnd("o_totalprice", 2).alias("distance_m"), (F.col("o_orderkey") * 17 % 360).cast("double").alias("bearing_deg"))
    yaw = o.select(F.col("o_custkey").alias("id")).distinct().withColumn("yaw_deg", (F.col("id") % 360).cast("double"))
    return graph.face_moves(e, yaw).select("id", "face", "dst", "off")


@query("""
WITH g AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), p AS (SELECT quantile_disc(o_totalprice, [0.1, 0.5, 0.9]) AS q FROM orders)
SELECT count(*) AS n_nodes, round(avg(k), 6) AS mean_degree, min(k) AS min_degree, max(k) AS max_degree, (SELECT count(*) FROM orders) AS n_edges, round((SELECT q[1] FROM p), 4) AS p10_m, round((SELECT q[2] FROM p), 4) AS p50_m, round((SELECT q[3] FROM p), 4) AS p90_m FROM g""")
def q_graph_diagnostics(spark, d):
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("distance_m"))
    g = graph.graph_diagnostics(e)
    return g.select("n_nodes", rnd("mean_degree").alias("mean_degree"), "min_degree", "max_degree", "n_edges", *[rnd(c, 4).alias(c) for c in ("p10_m", "p50_m", "p90_m")])


@query("""
SELECT user_id AS walk, count(*) AS n_steps, count(DISTINCT event_id % 20) AS n_nodes, round(1 - count(DISTINCT event_id % 20) / count(*), 6) AS revisit_rate, arg_max(event_id % 7, event_id) AS last FROM events GROUP BY user_id""")
def q_walk_diagnostics(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("walk"), F.col("event_id").alias("step"), (F.col("event_id") % 20).alias("id"), (F.col("event_id") % 7).alias("dst"))
    return graph.walk_diagnostics(e).withColumn("revisit_rate", rnd("revisit_rate"))


# --- sources and writers

@query("SELECT event_type AS dataset, day(ts)::INTEGER AS year, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'signup') AND day(ts) IN (3, 4, 5) GROUP BY ALL")
def q_partitioned_scan(spark, d):
    path = scratch(spark, "catalog")
    writers.write_partitioned(t(spark, d, "events").select("event_id", "value", F.col("event_type").alias("dataset"), F.dayofmonth("ts").alias("year")), path)
    return readers.scan_catalog(spark, path, ["click", "signup"], [3, 4, 5]).groupBy("dataset", "year").agg(F.count("*").alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value FROM events")
def q_rewrite_in_place(spark, d):
    path = scratch(spark, "rewrite")
    writers.write_partitioned(t(spark, d, "events").select("event_id", "value", F.col("event_type").alias("dataset"), F.dayofmonth("ts").alias("year")), path)
    spark.catalog.refreshByPath(path)
    writers.rewrite(spark, path, lambda df: df.where("dataset = 'click'").withColumn("value", F.col("value") + 1), scratch(spark, "staging"))
    return spark.read.parquet(path).select("event_id", "value")


@query("SELECT s_suppkey::VARCHAR AS \"imageId\", s_acctbal AS lat, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS lon_code FROM supplier")
def q_dirty_csv(spark, d):
    path = scratch(spark, "csv")
    s = t(spark, d, "supplier")
    s.select(F.col("s_suppkey").alias("imageId"), F.col("s_acctbal").alias("lat"), F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(F.col("s_nationkey").cast("string")).alias("lon_code"), F.lit("2025-05-01T11:45:00.0700000-04:00").alias("recordedAt")).coalesce(1).write.csv(f"{path}/a", header=True)
    s.where("s_suppkey <= 10").select(F.col("s_suppkey").alias("imageId"), F.lit("later file").alias("note")).coalesce(1).write.csv(f"{path}/b", header=True)
    return readers.read_recordings_csv(spark, [f"{path}/a", f"{path}/b"], "imageId string, lat double, lon_code int, recordedAt timestamp").drop("recordedAt")


@query("SELECT c_custkey AS id, c_name AS name, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS n_bad FROM customer WHERE c_custkey % 10 <> 0")
def q_registry_lines(spark, d):
    path = scratch(spark, "registry")
    line = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    t(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("{cut "), "c_name")).otherwise(line).alias("value")).write.text(path)
    records, bad = readers.read_registry(spark, path, "id long, name string")
    return records.join(F.broadcast(bad), F.lit(True))


@query("SELECT n_name AS name, n_regionkey::VARCHAR AS region, n_nationkey * 1.0::DOUBLE AS x0, 4::INTEGER AS n_points FROM nation")
def q_polygons(spark, d):
    n = t(spark, d, "nation")
    k = F.col("n_nationkey").cast("double")
    at = lambda a, b: F.array(k + a, F.lit(float(b)))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("properties"), shape.alias("geometry")))
    path = scratch(spark, "geojson")
    n.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    p = readers.read_polygons(spark, path, ["name", "region"])
    return p.select("name", "region", F.array_min(F.transform("ring", lambda q: q["x"])).alias("x0"), F.size("ring").alias("n_points"))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL")
def q_load_run(spark, d):
    e = t(spark, d, "events")
    return readers.load_run(e.select("event_id", F.when(F.col("value").isNull(), "n/a").otherwise(F.col("value").cast("string")).alias("value")), e.select("event_id", "user_id"), "event_id", "value").select("event_id", "value")
