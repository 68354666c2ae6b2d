"""Invariants, planted effects and edge cases of operators that SQL does not cover."""

import json
import math
import random
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.functions import columns, geo, nested, stats, text
from quadrat.operators import batch_map, graph, judgments, models, rows, sampling, spans, spatial, timeline, vectors
from quadrat.plans import dag, normalize, validation
from quadrat.sources import readers, writers


def one(df):
    return df.collect()[0]


def test_labels(spark):
    raw = ["MuchMore", "much less", '{"answer": "MuchLess"}', "I am not sure", "equal", "", None, "yes", "cannot tell", "banana", "More_", "no"]
    want = ["MuchMore", "MuchLess", "MuchLess", "NotSure", "Same", "Same", "Same", "More", "NotSure", "Same", "More", "Less"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, answer string")
    assert [r[0] for r in df.orderBy("i").select(judgments.canonical_label(F.col("answer"))).collect()] == want


def test_swaps_flip_relative_labels_only(spark):
    df = judgments.derive_labels(spark.createDataFrame([("MuchMore", True), ("Less", None), ("not sure", True)], "answer string, is_swapped boolean"))
    assert [(r.presented_label, r.relative_label, r.relative_score) for r in df.collect()] == [("MuchMore", "MuchLess", -2), ("Less", "Less", -1), ("NotSure", "NotSure", None)]


def test_first_per_keeps_nulls_first_valid_skips_them(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y")], "k string, o int, v string")
    assert {r.k: r.v for r in rows.first_per(df, ["k"], F.col("o")).collect()} == {"a": None, "b": "y"}
    assert {r.k: r.v for r in rows.first_valid(df, ["k"], ["v"], F.col("o")).collect()} == {"a": "x", "b": "y"}


def test_sentinels_and_null_keys(spark):
    df = spark.createDataFrame([("i1", "none"), ("i1", "car"), ("i2", "none"), (None, "none")], "k string, v string")
    got = {(r.k, r.v) for r in rows.without_sentinels(df, ["k"], F.col("v") == "none").collect()}
    assert got == {("i1", "car"), ("i2", "none"), (None, "none")}
    assert rows.distinct_keep_nulls(spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string"), ["k"]).count() == 3


def test_validated_joins_raise(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError, match="not unique"):
        rows.join_many_to_one(a, b, ["k"]).count()


def test_quotas():
    assert sampling.even_quotas({"a": 1, "b": 10, "c": 10}, 9) == {"a": 1, "b": 4, "c": 4}
    assert sampling.even_quotas({None: 5, "a": 10}, 6)[None] == 0
    assert sampling.even_quotas({"a": 1000, "b": 1}, 100) == {"a": 99, "b": 1} and sampling.even_quotas({"a": 3, "b": 9, "c": 9}, 14) == {"a": 3, "b": 6, "c": 5}
    assert sampling.even_quotas({}, 3) == {} and sampling.even_quotas({"a": 2, "b": 1}, 50) == {"a": 2, "b": 1}
    assert sum(sampling.proportional_quotas({"a": 50, "b": 30, "c": 20}, 7).values()) == 7


def test_splits_cover_and_repeat(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 7)
    a = sampling.split_within(df, "s", 0.8, 1, "id")
    assert a.count() == 1000 and a.groupBy("s").agg(F.count_distinct("split").alias("n")).where("n < 2").count() == 0
    assert a.where("split = 'train'").agg(F.sum("id")).first() == sampling.split_within(df.repartition(3), "s", 0.8, 1, "id").where("split = 'train'").agg(F.sum("id")).first()


def test_stride_shards_keep_groups_whole(spark):
    df = spark.range(500).select("id", (F.col("id") % 97).alias("g"))
    s = sampling.stride_shards(df, "g", "id", 4)
    assert s.count() == 500 and s.groupBy("g").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    assert {r.shard for r in s.where("g < 4").collect()} == {0, 1, 2, 3}


def test_pairs(spark):
    p = sampling.distinct_pairs(spark.range(60), "id", 300, 5)
    got = {frozenset((r.a, r.b)) for r in p.collect()}
    assert len(got) == 300 and all(len(x) == 2 for x in got)
    assert sampling.distinct_pairs(spark.range(5), "id", 99, 1).distinct().count() == 10 and sampling.distinct_pairs(spark.range(1), "id", 9, 1).count() == 0
    many = sampling.distinct_pairs(spark.range(100_000).select((F.col("id") * 3).alias("id")), "id", 5000, 2)
    assert many.select(F.least("a", "b"), F.greatest("a", "b")).where("a != b and a % 3 = 0 and b % 3 = 0").distinct().count() == 5000
    low, high = sampling.pair_of(F.col("p"))
    numbered = spark.createDataFrame([(p,) for p in (0, 1, 2, 3, 5, 10**15, 4 * 10**17, 4 * 10**17 + 1)], "p long").select("p", low.alias("x"), high.alias("y")).collect()
    assert all(0 <= r.x < r.y and r.y * (r.y - 1) // 2 + r.x == r.p for r in numbered)
    t = sampling.pair_table(p, 2, "balanced")
    assert t.count() == 600 and t.where("is_swapped").count() == 300
    m = sampling.perfect_matching(spark.range(21), "id", 3).collect()
    assert len(m) == 10 and len({x for r in m for x in (r.a, r.b)}) == 20


def test_weighted_draw_follows_weights_and_falls_back(spark):
    df = spark.range(2000).select((F.col("id") / 2).cast("long").alias("g"), (F.col("id") % 2).alias("i"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"), "id")
    got = sampling.weighted_one(df, ["g"], "w", 1, "id")
    share = got.where("i = 0").count() / 1000
    assert got.count() == 1000 and 0.7 < share < 0.8
    assert sampling.weighted_one(df.withColumn("w", F.lit(0.0)), ["g"], "w", 1, "id").count() == 1000


def test_rating_fold_orders_and_prefers_winners(spark):
    games = [(i, "a", "b", 1.0) for i in range(30)] + [(99, "a", "a", 1.0), (100, "a", None, 1.0)]
    r = {x.unit_uid: x for x in models.fold_ratings(spark.createDataFrame(games, "seq int, ua string, ub string, s double"), [], "seq", "ua", "ub", "s").collect()}
    assert r["a"].mu > 25 > r["b"].mu and r["a"].n_comparisons == 30 and r["a"].sigma < 25 / 3
    even = models.fold_ratings(spark.createDataFrame([(1, "x", "y", 0.0)], "seq int, ua string, ub string, s double"), [], "seq", "ua", "ub", "s").collect()
    assert all(abs(x.mu - 25) < 1e-9 for x in even)
    first = {x.unit_uid: x for x in models.fold_ratings(spark.createDataFrame([(1, "x", "y", 1.0)], "seq int, ua string, ub string, s double"), [], "seq", "ua", "ub", "s").collect()}
    assert abs(first["x"].mu - 29.396) < 0.01 and abs(first["x"].sigma - 7.171) < 0.01


def test_ols_recovers_planted_slope(spark):
    df = spark.range(2000).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), ((F.xxhash64("id") % 100) / 100.0).alias("e"))
    df = df.withColumn("y", 3 * F.col("x") - 2 * F.col("z") + 1 + F.col("e"))
    r = models.ols(df, "y", ["x", "z"])
    assert abs(r["coef"]["x"] - 3) < 0.02 and abs(r["coef"]["z"] + 2) < 0.04 and r["r2"] > 0.99 and 0 < r["se_hc3"]["x"] < 0.01
    assert models.partial_r2(df, "y", "x", ["z"]) > 0.99


def test_null_control_and_planted_effect(spark):
    def pairs(effect):
        return spark.range(600).select(F.col("id").cast("string").alias("canonical_pair_id"), F.lit("g1").alias("group_a"), F.lit("g2").alias("group_b"), (F.pmod(F.xxhash64("id"), F.lit(5)) - 2 + effect).cast("int").alias("relative_score"))

    assert abs(one(judgments.head_to_head(pairs(0), "g1", "g2")).t) < 3
    hit = one(judgments.head_to_head(pairs(1), "g1", "g2"))
    back = one(judgments.head_to_head(pairs(1), "g2", "g1"))
    assert hit.t > 10 and hit.p_normal < 1e-6 and abs(hit["mean"] + back["mean"]) < 1e-12


def test_facing_and_occlusion(spark):
    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    b = spark.createDataFrame([("own", [{"x": a, "y": c} for a, c in square(0.0, 18.0, 5.0)]), ("blk", [{"x": a, "y": c} for a, c in square(0.0, 6.0, 2.0)])], "bin string, ring array<struct<x:double,y:double>>")
    r = spark.createDataFrame([("F", 0.0, 0.0, 0.0), ("B", 0.0, 0.0, 180.0), ("U", 0.0, 0.0, None)], "face string, x double, y double, b double")
    assert [x.face for x in spatial.facing(r, b.where("bin = 'own'"), "face", "b", "ring", 30.0, 15, 10.0).collect()] == ["F"]
    lines = spark.createDataFrame([("hit", "own", 0.0, 0.0, 0.0, 13.0), ("free", "own", 8.0, 0.0, 4.0, 13.5), ("unkeyed", None, 0.0, 0.0, 0.0, 13.0)], "k string, own string, x double, y double, tx double, ty double")
    assert {x.k for x in spatial.not_occluded(lines, b, "k", "own", "bin", "ring", 10.0).collect()} == {"free", "unkeyed"}


def test_geometry_cascade(spark):
    b = spark.createDataFrame([("1", [{"x": a, "y": c} for a, c in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))])], "bin string, ring array<struct<x:double,y:double>>")
    u = spark.createDataFrame([("a", "1", None, None), ("b", None, 15.0, 5.0), ("c", "9", 500.0, 5.0), ("d", None, None, None)], "uid string, bin string, x double, y double")
    got = {r.uid: (r.geom_source, r.matched_bin, r.match_dist) for r in spatial.geometry_cascade(u, b, "uid", "bin", "ring", 50.0, 60.0).collect()}
    assert got == {"a": ("bin", "1", 0.0), "b": ("nearest", "1", 5.0), "c": ("point", None, None), "d": ("none", None, None)}


def test_projections_at_known_places(spark):
    """Origins by definition, metres a degree on the central meridian, and published coordinates of a landmark."""
    one = lambda la, lo: spark.createDataFrame([(la, lo)], "a double, o double").select(*geo.utm_xy(F.col("a"), F.col("o")), *geo.state_plane_ft(F.col("a"), F.col("o"))).first()
    x, y, _, _ = one(0.0, -75.0)
    assert abs(x - 500_000) < 1e-6 and abs(y) < 1e-6
    _, _, x, y = one(40 + 10 / 60, -74.0)
    assert abs(x - 984_250) < 1e-3 and abs(y) < 1e-3
    x, y, px, py = one(40.748441, -73.985664)
    assert abs(x - 585_628) < 30 and abs(y - 4_511_323) < 30 and abs(px - 988_220) < 60 and abs(py - 211_950) < 100
    # the meridian's length from the equator to 45 degrees on this ellipsoid
    assert abs(one(45.0, -75.0)[1] / 0.9996 - 4_984_944.378) < 0.01


def test_wkb_point_is_exact(spark):
    import struct

    pts = [(-73.9857, 40.7484), (0.0, -1.5), (1e-7, 179.999)]
    got = [bytes(r[0]) for r in spark.createDataFrame(pts, "x double, y double").coalesce(1).select(geo.wkb_point(F.col("x"), F.col("y"))).collect()]
    assert got == [struct.pack("<BIdd", 1, 1, *p) for p in pts]


def test_quotes_json_and_text(spark):
    df = spark.createDataFrame([("The  quick\nbrown fox", "quick brown"), ("abc (d) e", "(d)"), ("abc", "zzz"), ("abc", "")], "t string, q string")
    got = [tuple(r[0]) for r in df.coalesce(1).select(text.locate_quote(F.col("t"), F.col("q"))).collect()]
    assert got == [(5, 16, "whitespace"), (4, 7, "exact"), (None, None, "none"), (None, None, "none")]
    for cut, want in (('{"a": [1, 2', None), ('{"a": "x', None), ('{"a": {"b": 1}, "c": [{"d": "e"', '{"a": {"b": 1}}'), ('{"a": [1, {"b": "}"}, 2', '{"a": [1, {"b": "}"}]}'), ('noise {"a": 1} tail', '{"a": 1}')):
        assert nested.close_json(cut)[0] == want
    assert nested.close_json("no json") == (None, False)
    f = nested.repaired_json(spark.createDataFrame([('{"a": [[1], 2',), ('{"a": 1}',), (None,)], "s string"), "s").collect()
    assert [r.json_repaired for r in f] == [True, False, False] and f[0].json == '{"a": [[1]]}'
    names = spark.createDataFrame([("Cleanliness of the platform",), ("platform cleanliness",)], "n string").select(text.word_set_key(F.col("n"))).distinct()
    assert names.count() == 1
    hosts = one(spark.createDataFrame([("n[01-03,07],m5",)], "h string").select(text.host_list(F.col("h"))))[0]
    assert hosts == ["n01", "n02", "n03", "n07", "m5"]


def test_segments_and_chunks(spark):
    seg = spark.createDataFrame([([(5.0, 6.0), (0.0, 2.0), (2.2, 3.0), (10.0, 35.0)],), ([],)], "s array<struct<start:double,end:double>>").coalesce(1)
    got = [[tuple(x) for x in r[0]] for r in seg.select(timeline.pack_segments(F.col("s"), 10.0, 0.5)).collect()]
    assert got == [[(0.0, 3.0), (5.0, 6.0), (10.0, 20.0), (20.0, 30.0), (30.0, 35.0)], []]
    w = [[tuple(x) for x in r[0]] for r in spark.createDataFrame([(25,), (3,), (0,)], "n int").coalesce(1).select(timeline.chunk_bounds(F.col("n"), 10, 0, 6)).collect()]
    assert w == [[(0, 10), (10, 20)], [(0, 3)], []]
    c = one(spark.createDataFrame([(["a", "a", "b", "a"],)], "x array<string>").select(nested.collapse_repeats(F.col("x"))))[0]
    assert c == ["a", "b", "a"]


def test_thinning_restarts(spark):
    df = spark.createDataFrame([(1, i, 4.0) for i in range(8)], "g int, o int, d double")
    assert sorted(r.o for r in timeline.thin_by_distance(df, ["g"], "o", "d", 10.0).collect()) == [0, 3, 6]


def test_passes_and_edges(spark):
    rows_ = [("a", 0, 40.0, 0.0), ("b", 5, 40.0001, 0.0), ("c", 10, 40.0002, 90.0), ("d", 200, 40.0003, 90.0)]
    df = spark.createDataFrame([(i, k, y, -74.0, h) for k, i, y, h in rows_], "s int, k string, lat double, lon double, yaw double").withColumn("ts", F.timestamp_seconds("s")).withColumn("v", F.lit(1))
    p = timeline.passes(df, ["v"], "ts", "lat", "lon", "yaw", 60, 100, 60)
    assert {r.k: r.pass_id for r in p.collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    e = timeline.along_edges(p, ["v"], "k", "ts", "lat", "lon", 50).collect()
    assert {(r.src, r.dst) for r in e} == {("a", "b"), ("b", "a")} and {round(r.bearing_deg) % 360 for r in e} == {0, 180}


def test_matching_and_components(spark):
    c = spark.createDataFrame([("l1", "r1", 1.0), ("l1", "r2", 2.0), ("l2", "r1", 1.5), ("l2", "r2", 3.0)], "l string, r string, c double")
    assert {(x.l, x.r) for x in graph.greedy_matching(c, "l", "r", "c").collect()} == {("l1", "r1"), ("l2", "r2")}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200


def test_code_ladder(spark):
    q = [{"method": "exact"}]
    def row(doc, kind, attrs=None, name=None, at=0, found=True):
        return ("c", "m", doc, kind, at, name, found, False, at, json.dumps(attrs or {}))

    data = [
        row("d1", "dimension", {"image": "A"}, "trees"), row("d2", "hedge"),
        *[row("d3", "perspective", {"favors": f, "supporting_quotes": q}) for f in "AB"],
        *[row("d5", "perspective", {"favors": f, "supporting_quotes": q}) for f in "AB"], row("d5", "weighing", {"justification_quotes": q}),
        *[row("d6", "perspective", {"favors": f, "supporting_quotes": q}) for f in "AB"], row("d6", "weighing", {"justification_quotes": q, "mechanism": "conditional"}),
        *[row("d4", "perspective", {"favors": f, "supporting_quotes": q}) for f in "AB"], row("d4", "verdict", {"label": "More"}, at=9), row("d4", "verdict", {"label": "Less"}, at=2),
        row("d7", "hedge", found=False),
    ]
    df = spark.createDataFrame(data, "case string, judge_model string, doc_id string, ingredient_type string, ingredient_index int, name string, quote_found boolean, answer_truncated boolean, char_start int, attrs_json string")
    got = {r.doc_id: r for r in spans.trace_codes(df).collect()}
    assert {k: v.ic_code for k, v in got.items()} == {"d1": 1, "d2": 2, "d3": 3, "d4": 4, "d5": 5, "d6": 6, "d7": 1}
    assert got["d4"].verdict_labels == "Less|More" and got["d4"].verdict_final == "More" and got["d7"].n_unlocated == 1


def test_statistics(spark):
    r = one(spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select(*stats.wilson(F.col("k"), F.col("n"))).coalesce(1))
    assert abs(r[0] - 0.4902) < 1e-3 and abs(r[1] - 0.9433) < 1e-3
    p = one(spark.range(1).select(stats.normal_two_sided(F.lit(1.96))))[0]
    assert abs(p - 0.05) < 1e-4
    t = models.kendall_tau_b(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "x double, y double"), "x", "y").first()
    assert abs(t.tau_b - 2 / 3) < 1e-12


def test_rerank_ranks_before_threshold(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.7)], "k string, s double")
    assert [(r.k, r.rerank_rank) for r in vectors.rerank(df, "s", "k", 0.6).orderBy("k").collect()] == [("a", 1), ("c", 2)]
    assert vectors.reduce_dimensions(spark.createDataFrame([([1.0, 2.0, 3.0],), ([2.0, 1.0, 0.0],), ([0.0, 1.0, 5.0],)], "v array<double>"), "v", 2).first()["reduced"].__len__() == 2


def test_dag_orders_and_rejects(spark):
    reg = dag.Registry()
    reg.stage("double")(lambda s, i, c: {"out": i["x"].select((F.col("id") * c["by"]).alias("id"))})
    spec = dag.Pipeline.from_dict({"sources": {}, "nodes": {"b": {"stage": "double", "inputs": {"x": "a.out"}, "outputs": {"out": None}, "settings": {"by": 3}}, "a": {"stage": "make", "outputs": {"out": None}}}})
    reg.stage("make")(lambda s, i, c: {"out": s.range(3)})
    assert [r.id for r in reg.run(spark, spec)["b.out"].collect()] == [0, 3, 6]
    with pytest.raises(ValueError, match="cycle"):
        dag.Pipeline.from_dict({"nodes": {"a": {"stage": "s", "depends_on": ["b"]}, "b": {"stage": "s", "depends_on": ["a"]}}}).order()
    with pytest.raises(ValueError, match="unknown"):
        dag.Pipeline.from_dict({"nodes": {"a": {"stage": "s", "inputs": {"x": "zz.out"}}}}).order()


def test_fatal_rules_raise(spark):
    with pytest.raises(validation.ValidationError, match="positive"):
        validation.enforce(validation.report(spark.range(3), [validation.Rule("positive", F.col("id") < 1, fatal=True)]))


def test_normalizers(spark):
    a = spark.createDataFrame([("J1", "2024-01-01T00:00:00.000", "1", "1", "Manhattan", " 12 ", "Main", "nan")], "job_filing_number string, first_permit_date string, scaffold string, shed string, borough string, house_no string, street_name string, initial_cost string")
    b = spark.createDataFrame([("9", "01", "SH", "02/03/2024", "x")], "job__ string, permit_sequence__ string, permit_subtype string, issuance_date string, gis_latitude string")
    got = {r.source: r for r in normalize.all_permits(a, b).collect()}
    assert got["dob_now"].scaffold_type == "both" and got["dob_now"].address == "12 Main" and got["dob_now"].initial_cost is None and got["dob_now"].issue_date.year == 2024
    assert got["bis"].permit_id == "9-01" and got["bis"].scaffold_type == "shed" and got["bis"].issue_date.month == 2 and got["bis"].raw_latitude is None
    lic = spark.createDataFrame([("A", "1", "Cafe", "40.75", "-73.98"), ("B", "1", "Cafe", "40.75", "-73.98"), ("C", "2", "Cafe", None, None)], "business_legal_name string, bbl string, license_type string, latitude string, longitude string")
    uids = sorted(r.uid for r in normalize.licences(lic).collect())
    assert len(set(uids)) == 3 and uids[0].endswith("_0") and uids[1].endswith("_1")
    with pytest.raises(ValueError, match="did you mean"):
        normalize.vocabulary_or_raise(["Librarys"], ["Libraries", "Parks"])
    assert one(spark.range(1).select(columns.borough_of(F.lit("Manhattan"), F.lit("3"))))[0] == "BROOKLYN"


def test_files(spark, tmp_path):
    for k, group in enumerate(("W0X", "W0X", "W0Y")):
        base = tmp_path / "raw" / "manhattan_synthetic" / group / f"REC{k}"
        (base / "faces").mkdir(parents=True)
        for f in "FBLRUD":
            (base / "faces" / f"{f}.jpg").write_bytes(b"x" * (10 + k))
        (base / "manifest.json").write_text(json.dumps({"imageId": f"REC{k}", "label": "-73.98,40.75"}) if k else "{broken")
    (tmp_path / "raw" / "stray.jpg").write_bytes(b"x")
    imgs = readers.list_images(spark, [str(tmp_path / "raw")])
    assert imgs.count() == 18 and imgs.select("dataset").distinct().first()[0] == "manhattan_synthetic"
    m = readers.read_manifests(spark, str(tmp_path / "raw"), "imageId string, label string")
    assert {r.recording_dir: r.manifest_ok for r in m.collect()} == {"REC0": False, "REC1": True, "REC2": True}
    root = str(tmp_path / "cat")
    df = spark.createDataFrame([("a", 2023, 1), ("a", 2024, 2), ("b", 2024, 3)], "dataset string, year int, v int")
    writers.write_partitioned(df, root)
    writers.write_partitioned(spark.createDataFrame([("a", 2024, 9)], df.schema), root)
    assert sorted(r.v for r in readers.scan_catalog(spark, root).collect()) == [1, 3, 9]
    assert [r.v for r in readers.scan_catalog(spark, root, ["a"], [2024]).collect()] == [9]
    (tmp_path / "log.jsonl").write_text('{"k": "a", "n": 1}\nnot json\n{"k": "a", "n": 2}\n')
    good, bad = readers.read_registry(spark, str(tmp_path / "log.jsonl"), "k string, n int")
    assert one(rows.latest_record(good, "k", "n")).n == 2 and one(bad).n_bad == 1
    assert writers.fingerprint({"b": 1, "a": 2}) == writers.fingerprint({"a": 2, "b": 1})


def test_batch_map_keeps_failed_rows(spark):
    def run(batch):
        if any(r["id"] == 7 for r in batch):
            raise RuntimeError("boom")
        return [{"y": r["id"] * 2} for r in batch]

    got = batch_map.batch_map(spark.range(0, 10, 1, 1), run, "y long", ["id"], ["id"], chunk=5)
    assert got.count() == 10 and got.where("error is not null").count() == 5 and batch_map.rows_to_do(spark.range(10), got, "id").count() == 5
    tree = {"if": "id > 5", "then": "big", "else": {"if": "id > 2", "then": "mid", "else": "low"}}
    assert [r.decision for r in batch_map.decision_tree(spark.createDataFrame([(1,), (4,), (9,)], "id int").coalesce(1), tree).collect()] == ["low", "mid", "big"]


def test_hash_unit_is_uniform(spark):
    m = spark.range(20000).select(columns.hash_unit(1, F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(m[0] - 0.5) < 0.01 and 0 <= m[1] and m[2] < 1 and math.isfinite(m[0])


def test_snap_ties_go_to_the_nearer_then_the_smaller_edge(spark):
    """Points on two overlapping edges are at distance 0 from both, whatever share of an edge they lie at."""
    p = spark.createDataFrame([(i, 0.7 + i * 0.37, 1.0, 76.0) for i in range(40)], "k int, x double, y double, h double")
    e = spark.createDataFrame([(1, 0.1, 1.0, 30.1, 1.0), (2, -3.3, 1.0, 26.7, 1.0), (3, 0.3, 1.0, 30.3, 1.0)], "edge int, ax double, ay double, bx double, by double")
    got = graph.snap_to_edges(p, e, "k", "h", "edge", 50.0, 25.0, 0.1).collect()
    assert len(got) == 40 and {(r.edge, r.dist) for r in got} == {(1, 0.0)}


def test_batch_map_sends_small_chunks_together(spark):
    """Chunks of one row do not each become a frame; large integers beside failed rows stay exact."""
    big = (1 << 60) + 1

    def run(batch):
        if batch[0]["id"] % 3 == 0:
            raise RuntimeError("boom")
        return [{"y": big + r["id"]} for r in batch]

    df = batch_map.batch_map(spark.range(0, 3000, 1, 1), run, "y long", ["id"], ["id"], chunk=1)
    assert {r.id: r.y for r in df.collect()} == {i: None if i % 3 == 0 else big + i for i in range(3000)}

    class Held:
        """Gives the function that would run in the tasks."""

        schema, select, mapInPandas = spark.range(1).schema, lambda self, *a: self, lambda self, f, s: f

    frames = list(batch_map.batch_map(Held(), run, "y long", ["id"], ["id"], chunk=1)(iter([pd.DataFrame({"id": range(3000)})])))
    assert len(frames) <= 3 and sum(map(len, frames)) == 3000


def test_facing_own_does_not_join_all_that_share_a_key(spark):
    """The rows between the joins and the exact test follow the near polygons, not all of the same key."""
    square = lambda x, y, r: [{"x": x + a * r, "y": y + b * r} for a, b in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))]
    polygons = spark.createDataFrame([(1, square(100.0 * i, 18.0, 5.0)) for i in range(50)] + [(2, square(0.0, 18.0, 5.0))], "k int, ring array<struct<x:double,y:double>>")
    rays = spark.createDataFrame([(i, 1, 100.0 * i, 0.0, 0.0) for i in range(50)] + [(50, 3, 0.0, 0.0, 0.0), (51, None, 0.0, 0.0, 0.0)], "r int, own int, x double, y double, b double")
    df = spatial.facing(rays, polygons, "r", "b", "ring", 30.0, 15, 10.0, own=("own", "k"))
    assert {(x.r, x.hits, x.first_hit) for x in df.collect()} == {(i, 5, 14.0) for i in range(50)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert any("_cx" in line and "_own" in line for line in plan.splitlines() if "Join Inner" in line)


def test_nearest_ring_is_exact_and_measures_few_pairs(spark):
    """Triangles of which many equal others or crowd one place, against brute force; equal rings and far ones are not measured."""
    import random

    rng = random.Random(5)
    rings = []
    for i in range(60):
        x, y, r = rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(1, 60 if i % 9 == 0 else 12)
        rings.append([(x, y), (x + r, y + r / 3), (x + r / 2, y + r)])
    rows = [(i, [{"x": a, "y": b} for a, b in rings[i % 60]]) for i in range(1200)]
    polygons = spark.createDataFrame(rows, "b int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, rng.uniform(-50, 450), rng.uniform(-50, 450)) for i in range(300)], "k int, x double, y double")
    every = points.crossJoin(polygons.where("b < 60")).withColumn("d", geo.ring_distance(F.col("x"), F.col("y"), F.col("ring"))).where("d <= 60")
    want = {r.k: (r.m.b, round(r.m.d, 9)) for r in every.groupBy("k").agg(F.min(F.struct(F.rint(F.col("d") * 1e9), "b", "d")).alias("m")).collect()}
    got = spatial.geometry_cascade(points.withColumn("bin", F.lit(None).cast("int")), polygons.withColumnRenamed("b", "bin"), "k", "bin", "ring", 100.0, 60.0)
    assert {r.k: (r.matched_bin, round(r.match_dist, 9)) for r in got.where("geom_source = 'nearest'").collect()} == want and len(want) > 200
    # the grouping of equal rings stands below the join with cells
    assert "Aggregate [ring" in got._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_over_many_partitions(spark):
    """Ranks of many distinct values in range partitions that are not merged into one."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        df = spark.range(40000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") * 7919 % 32003).cast("double").alias("v"))
        got = judgments.rating_level(df, "g", "v", "a", "b").first()
    finally:
        spark.conf.unset(name)
    at, ranks, below = {}, 0.0, 0
    for i in range(40000):
        n = at.setdefault(i * 7919 % 32003, [0, 0])
        n[0] += 1
        n[1] += i % 3 == 0
    for _, (n, a) in sorted(at.items()):
        ranks, below = ranks + a * (below + (n + 1) / 2), below + n
    assert got.mann_whitney_u == ranks - got.n_a * (got.n_a + 1) / 2


def test_snap_searches_only_as_far_as_needed(spark):
    """Edges and points in all directions: as all pairs give it; copies of an edge and of a point meet once."""
    rng = random.Random(7)
    pts = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([None, rng.uniform(0, 360)]) if i % 9 == 0 else rng.uniform(0, 360)) for i in range(300)]
    segs = []
    for k in range(150):
        ax, ay, turn, long = rng.uniform(-60, 20), rng.uniform(-60, 60), rng.uniform(0, 2 * math.pi), rng.choice([0, 3, 90])
        segs.append((k, ax, ay, ax + long * math.cos(turn), ay + long * math.sin(turn)))
    points, edges = spark.createDataFrame(pts, "k int, x double, y double, h double"), spark.createDataFrame(segs, "edge int, ax double, ay double, bx double, by double")
    line = F.pmod(F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), F.lit(360.0))
    turn = F.least(geo.angle_between(F.col("h"), line), geo.angle_between(F.col("h"), F.pmod(line + 180, F.lit(360.0))))
    all_pairs = points.crossJoin(edges).withColumn("dist", geo.segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])).where("dist <= 25").withColumn("score", F.col("dist") + 0.1 * turn)
    want = all_pairs.groupBy("k").agg(F.min(F.struct(F.rint(F.col("score") * 1e9).alias("s"), "dist", "edge", "score")).alias("m")).select("k", "m.edge", "m.dist", "m.score")
    got = graph.snap_to_edges(points, edges, "k", "h", "edge", 50.0, 25.0, 0.1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # a pair for each copy of a street and of a point beside it would be 10,000,000,000
    street = spark.range(100000).selectExpr("cast(id as int) as edge", "0.0D as ax", "0.0D as ay", "30.0D as bx", "0.0D as by")
    stop = spark.range(100000).selectExpr("cast(id as int) as k", "5.0D as x", "1.0D as y", "90.0D as h")
    spark.sparkContext.setJobGroup("snap", "copies", True)
    timer = threading.Timer(120, spark.sparkContext.cancelJobGroup, ["snap"])
    timer.start()
    try:
        assert graph.snap_to_edges(stop, street, "k", "h", "edge", 50.0, 25.0, 0.1).agg(F.count("*"), F.max("edge"), F.min("dist"), F.max("score")).first() == (100000, 0, 1.0, 1.0)
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
