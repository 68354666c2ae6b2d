"""Composites over judgments, layers, zones and permits: operators joined into the tables that reports read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.operators.models import ols, partial_r2
from quadrat.operators.rows import first_per
from quadrat.operators.spatial import within


def quotable(spans: DataFrame, kind: str = "extraction_class", status: str = "alignment_status") -> DataFrame:
    """Spans that were aligned with their text and have a class."""
    return spans.where(F.col(status).isNotNull() & F.col(kind).isNotNull() & (F.trim(kind) != ""))


def split_population(df: DataFrame, column: str, parts: Mapping[str, Sequence[object]]) -> DataFrame:
    """Rows with ``part``, the first named list that holds their value; rows in no list go."""
    part = F.lit(None).cast("string")
    for name, values in reversed(list(parts.items())):
        part = F.when(F.col(column).isin(*values), name).otherwise(part)
    return df.withColumn("part", part).where("part is not null")


def long_enough(df: DataFrame, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ``least`` characters or more, one row: n, n_kept, mean_chars and max_chars of what is kept)."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    kept = F.when(n >= least, n)
    return df.where(n >= least), df.agg(F.count("*").alias("n"), F.count(kept).alias("n_kept"), F.avg(kept).alias("mean_chars"), F.max(kept).alias("max_chars"))


def merge_summary(traces: DataFrame, extractions: DataFrame, case: str, key: str) -> DataFrame:
    """Per case: traces, extractions, extractions a trace, traces without any, traces with a repeated key."""
    found = extractions.groupBy(case, key).agg(F.count("*").alias("_e"))
    t = traces.groupBy(case, key).agg(F.count("*").alias("_t")).join(found, [case, key], "left")
    return t.groupBy(case).agg(F.sum("_t").alias("n_traces"), F.coalesce(F.sum("_e"), F.lit(0)).alias("n_extractions"), (F.coalesce(F.sum("_e"), F.lit(0)) / F.sum("_t")).alias("per_trace"), F.count_if(F.col("_e").isNull()).alias("n_silent"), F.count_if(F.col("_t") > 1).alias("n_repeated"))


def unit_locations(images: DataFrame, unit: str, lat: str, lon: str) -> DataFrame:
    """Mean place and number of images of each unit; rows without a place do not count."""
    have = images.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return have.groupBy(unit).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count("*").alias("n_images"))


def zone_table(units: DataFrame, places: DataFrame, zones: DataFrame, unit: str, zone: str, ring: str, value: str, cell: float) -> DataFrame:
    """Units with a place, dealt to zones: every zone with its units, mean, deviation and number of distinct values."""
    placed = units.join(places, unit)
    inside = within(placed.withColumn("x", F.col("lon")).withColumn("y", F.col("lat")), zones.select(zone, ring), "x", "y", ring, cell)
    got = inside.groupBy(zone).agg(F.count_distinct(unit).alias("n_units"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count_distinct(value).alias("n_values"))
    return zones.select(zone).join(got, zone, "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


def answer_stats(answers: DataFrame, by: Sequence[str], parsed: str, truncated: str, repaired: str) -> DataFrame:
    """Answers, unparsed, cut and repaired ones of each group, and the rate of answers that parse."""
    p = F.col(parsed)
    return answers.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~p).alias("n_unparsed"), F.count_if(F.col(truncated)).alias("n_truncated"), F.count_if(F.col(repaired)).alias("n_repaired"), F.avg(p.cast("double")).alias("parse_rate"))


def permit_lifecycle(permits: DataFrame, buildings: DataFrame, key: str, issued: str, expires: str, closed: str, today: Column) -> DataFrame:
    """Every building with its latest permit and its state: none, closed, expired, active; n_permits and days since issue."""
    latest = first_per(permits.where(F.col(issued).isNotNull()), [key], F.desc(issued), F.desc_nulls_last(expires)).select(key, issued, expires, closed)
    counts = permits.groupBy(key).agg(F.count("*").alias("n_permits"))
    out = buildings.join(latest, key, "left").join(counts, key, "left").withColumn("n_permits", F.coalesce("n_permits", F.lit(0)))
    state = F.when(F.col(issued).isNull(), "none").when(F.col(closed).isNotNull() & (F.col(closed) <= today), "closed").when(F.col(expires) < today, "expired").otherwise("active")
    return out.withColumn("state", state).withColumn("days_open", F.when(state.isin("active", "expired"), F.datediff(today, issued)))


def compliance(observed: DataFrame, permitted: DataFrame, buffers: DataFrame, unit: str, ring: str, filed: str, cell: float) -> DataFrame:
    """Observed units with the latest filing whose place lies in their buffer: covered, expected or neither seen nor permitted.

    ``observed`` has unit and seen (boolean); ``permitted`` has x, y and the filing date.
    """
    inside = within(permitted.select("x", "y", filed), buffers.select(unit, ring), "x", "y", ring, cell)
    last = inside.groupBy(unit).agg(F.max(filed).alias("last_filed"), F.count("*").alias("n_filed"))
    out = observed.join(last, unit, "left").withColumn("n_filed", F.coalesce("n_filed", F.lit(0)))
    has, seen = F.col("n_filed") > 0, F.col("seen")
    return out.withColumn("status", F.when(seen & has, "covered").when(seen, "unpermitted").when(has, "unseen").otherwise("clear"))


def layer_table(layers: Mapping[str, DataFrame], zone: str, zones: DataFrame) -> DataFrame:
    """Full outer join of layers (zone and one value each), then every zone: n_layers counts the values that it has."""
    out = None
    for name, layer in layers.items():
        one = layer.select(F.col(zone), F.col([c for c in layer.columns if c != zone][0]).alias(name))
        out = one if out is None else out.join(one, zone, "full_outer")
    return zones.select(zone).join(out, zone, "left").withColumn("n_layers", sum((F.col(n).isNotNull().cast("int") for n in layers), F.lit(0)))


def regressions(analysis: DataFrame, specs: Mapping[str, tuple[str, Sequence[str]]], weight: str | None = None) -> DataFrame:
    """One row a specification and regressor: n, coefficient, HC3 error, t, standardized beta, partial R2, R2. A handful of rows."""
    rows = []
    for name, (y, xs) in specs.items():
        have = analysis.dropna(subset=[y, *xs])
        fit = ols(have, y, list(xs), weight)
        if "coef" not in fit:
            continue
        spread = have.agg(*[F.stddev_samp(c).alias(c) for c in (y, *xs)]).first()
        for x in xs:
            others = [o for o in xs if o != x]
            rows.append((name, x, int(fit["n"]), fit["coef"][x], fit["se_hc3"][x], fit["t"][x], fit["coef"][x] * spread[x] / spread[y] if spread[y] else None, partial_r2(have, y, x, others) if weight is None else None, fit["r2"]))
    return analysis.sparkSession.createDataFrame(rows, "spec string, regressor string, n long, coef double, se_hc3 double, t double, beta double, partial_r2 double, r2 double")


def results_table(cells: DataFrame, rows_: Sequence[str], block: str, blocks: Sequence[str], metrics: Sequence[str], repeated: Sequence[str] = ()) -> DataFrame:
    """Wide blocks of metrics (metric_block) for each row; values that repeat in every block stand once."""
    firsts = [F.min(c).alias(c) for c in repeated]
    return cells.groupBy(*rows_).agg(*firsts, *[F.max(F.when(F.col(block) == b, F.col(m))).alias(f"{m}_{b}") for b in blocks for m in metrics])


def newest_by_name(files: DataFrame, path: str, group: Sequence[str]) -> DataFrame:
    """The last file by name of each group: exports carry their date in the name."""
    return files.groupBy(*group).agg(F.max(path).alias(path))


def merge_expected(runs: DataFrame, references: DataFrame, keys: Sequence[str], candidates: Sequence[str], out: str = "expected") -> DataFrame:
    """Runs with the first reference column that has a value; without any, ``out`` is null and ``out``_source too."""
    have = [c for c in candidates if c in references.columns]
    one = references.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in have])
    source = F.coalesce(*[F.when(F.col(f"_{c}").isNotNull(), F.lit(c)) for c in have])
    return runs.join(one, list(keys), "left").withColumn(out, F.coalesce(*[F.col(f"_{c}").cast("string") for c in have])).withColumn(f"{out}_source", source).drop(*[f"_{c}" for c in have])


def with_group_results(long: DataFrame, keys: Sequence[str], layer: str, value: str, least: float) -> DataFrame:
    """The long frame with its group's first layer over a level, its peak and its rank from the top, by windows."""
    w = W.partitionBy(*keys)
    first = F.min(F.when(F.col(value) >= least, F.col(layer))).over(w)
    return long.withColumn("first_layer", first).withColumn("peak", F.max(value).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc(value), layer)))


def layer_summary(long: DataFrame, by: Sequence[str], layer: str, value: str, token: str, top: int = 3) -> DataFrame:
    """Per layer: rows, mean without NaN, share over 0, and the ``top`` commonest tokens, joined."""
    v = F.when(~F.isnan(value), F.col(value))
    means = long.groupBy(*by, layer).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg((v > 0).cast("double")).alias("share_positive"))
    counts = long.groupBy(*by, layer, token).agg(F.count("*").alias("_c"))
    tops = first_per(counts, [*by, layer], F.desc("_c"), F.col(token), n=top)
    tops = tops.groupBy(*by, layer).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("c"), F.col(token).alias("t")))), lambda x: x["t"]), "|").alias("top_tokens"))
    return means.join(tops, [*by, layer])


def layer_agreement(long: DataFrame, keys: Sequence[str], layer: str, answer: str, final: str) -> DataFrame:
    """Per layer the share of rows whose answer is already the final one."""
    return long.groupBy(layer).agg(F.count("*").alias("n"), F.avg((F.col(answer) == F.col(final)).cast("double")).alias("agreement")).orderBy(layer)


def dissolved(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """One row a key: its rings together (a point is in the whole if it is in one of them) and the box around all."""
    xs, ys = F.transform(F.col(ring), lambda p: p["x"]), F.transform(F.col(ring), lambda p: p["y"])
    return polygons.groupBy(key).agg(F.array_sort(F.collect_list(ring)).alias("rings"), F.min(F.array_min(xs)).alias("x0"), F.max(F.array_max(xs)).alias("x1"), F.min(F.array_min(ys)).alias("y0"), F.max(F.array_max(ys)).alias("y1"))


def by_first_key(stats: DataFrame, shapes: DataFrame, stat_key: str, candidates: Sequence[str]) -> DataFrame:
    """Inner join on the first of the shape's keys that has a value ("-99" is none)."""
    key = F.coalesce(*[F.when(~F.trim(F.col(c)).isin("", "-99"), F.trim(F.col(c))) for c in candidates])
    return stats.join(shapes.withColumn(stat_key, key).where(F.col(stat_key).isNotNull()), stat_key)


def minibatches(df: DataFrame, key: str, size: int, epochs: int, seed: object) -> DataFrame:
    """Every row once an epoch, dealt to batches of about ``size`` by hash: epoch, batch. No global order is made."""
    n = df.count()
    batches = max(1, -(-n // size))
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    return rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(str(seed)), "epoch", key), F.lit(batches)))


def save_stages(outputs: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    """Each stage's output as Parquet below ``root``; nested columns are kept, so no other format is needed."""
    paths = {}
    for name, df in outputs.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def annotations_to_rows(documents: DataFrame, key: str, spans: str) -> DataFrame:
    """One row a span of an annotated document (array of struct(class, text, start, end)); documents without any keep one row of nulls."""
    return documents.select(key, F.posexplode_outer(spans).alias("span_index", "_s")).select(key, "span_index", F.col("_s.class").alias("extraction_class"), F.col("_s.text").alias("extraction_text"), F.col("_s.start").alias("char_start"), F.col("_s.end").alias("char_end"))


def edge_bins(points: DataFrame, edges: DataFrame, key: str, edge: str, size: float, seed: object) -> DataFrame:
    """Points of an edge binned by their place along it, one by hash a bin: edge, bin, key, along. ``points`` know their edge."""
    j = points.join(edges.select(edge, "ax", "ay", "bx", "by"), edge)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    along = F.greatest(F.lit(0.0), F.least(length, F.try_divide((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy, length)))
    binned = j.select(edge, key, F.coalesce(along, F.lit(0.0)).alias("along")).withColumn("bin", F.floor(F.col("along") / size))
    return first_per(binned, [edge, "bin"], F.xxhash64(F.lit(str(seed)), F.col(key)), F.col(key)).select(edge, "bin", key, "along")


def edge_chain(bins: DataFrame, edges: DataFrame, key: str, edge: str) -> DataFrame:
    """Links between points in consecutive occupied bins of an edge, and between the tips of edges that meet in a node: src, dst, both ways."""
    w = W.partitionBy(edge).orderBy("bin")
    along = bins.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).where("dst is not null")
    ends = bins.groupBy(edge).agg(F.min_by(key, "bin").alias("_first"), F.max_by(key, "bin").alias("_last")).join(edges.select(edge, "from_node", "to_node"), edge)
    tips = ends.select(F.explode(F.array(F.struct(F.col("from_node").alias("node"), F.col("_first").alias("tip")), F.struct(F.col("to_node").alias("node"), F.col("_last").alias("tip")))).alias("t"), edge).select("t.*", edge)
    # a node joins few edges, so its tips meet in pairs
    a, b = tips.select("node", F.col("tip").alias("src"), F.col(edge).alias("_ea")), tips.select("node", F.col("tip").alias("dst"), F.col(edge).alias("_eb"))
    across = a.join(b, "node").where("_ea < _eb and src != dst").select("src", "dst")
    both = along.unionByName(across)
    return both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
