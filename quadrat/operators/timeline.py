"""Event sweeps, sessions, interval packing and windows over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.functions import geo


def occupancy(jobs: DataFrame, kind: str, start: str, end: str, amount: str, t0: int, t1: int, step: int) -> DataFrame:
    """Amount in use at the middle of every step: kind, t, busy.

    Intervals (epoch seconds) are clipped to [t0, t1); a null end is still running. Each change of level is
    dealt to the first sample not before it, so only steps, not events, are summed in order.
    """
    n = max(1, (t1 - t0) // step)
    s, e = F.greatest(F.col(start), F.lit(t0)), F.least(F.coalesce(F.col(end), F.lit(t1)), F.lit(t1))
    live = jobs.where(F.col(start).isNotNull() & (e > s)).select(kind, F.explode(F.array(F.struct(s.alias("t"), F.col(amount).alias("d")), F.struct(e.alias("t"), (-F.col(amount)).alias("d")))).alias("e"))
    at = F.greatest(F.lit(0), F.ceil((F.col("e.t") - t0) / step - 0.5)).cast("long")
    deltas = live.select(kind, at.alias("i"), F.col("e.d").alias("d")).where(F.col("i") < n).groupBy(kind, "i").agg(F.sum("d").alias("d"))
    grid = live.select(kind).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("i", F.col("i").cast("long"))
    busy = F.sum(F.coalesce("d", F.lit(0))).over(W.partitionBy(kind).orderBy("i"))
    return grid.join(deltas, [kind, "i"], "left").select(kind, (t0 + (F.col("i") + 0.5) * step).alias("t"), busy.alias("busy"))


def sessions(df: DataFrame, by: Sequence[str], order: Sequence[str], breaks: Column, out: str = "session") -> DataFrame:
    """Number sessions from 0: a row where ``breaks`` (which may use lag over ``ordered``) is true starts one."""
    w = W.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def gap_sessions(df: DataFrame, by: Sequence[str], ts: str, seconds: float, tie: Sequence[str] = ()) -> DataFrame:
    """Sessions that end with a pause of ``seconds`` or more."""
    w = W.partitionBy(*by).orderBy(ts, *tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return sessions(df, by, [ts, *tie], gap >= seconds * 1e6)


def passes(df: DataFrame, by: Sequence[str], ts: str, lat: str, lon: str, yaw: str, gap_s: float, gap_m: float, turn_deg: float) -> DataFrame:
    """Vehicle passes: a new one after a long pause, a jump, or a sharp turn. Adds pass_id and dist_m to the row before."""
    w = W.partitionBy(*by).orderBy(ts)
    lag = lambda c: F.lag(c).over(w)
    d = geo.haversine_m(lag(lat), lag(lon), F.col(lat), F.col(lon))
    turn = geo.angle_between(lag(yaw), F.col(yaw))
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(lag(ts).cast("timestamp"))
    with_d = df.withColumn("dist_m", F.coalesce(d, F.lit(0.0))).withColumn("_turn", turn).withColumn("_pause", pause)
    return sessions(with_d, by, [ts], (F.col("_pause") > gap_s * 1e6) | (F.col("dist_m") > gap_m) | (F.col("_turn") > turn_deg), "pass_id").drop("_turn", "_pause")


def along_edges(df: DataFrame, by: Sequence[str], key: str, ts: str, lat: str, lon: str, most_m: float) -> DataFrame:
    """Edges both ways between consecutive rows of a pass: src, dst, distance_m, bearing_deg."""
    w = W.partitionBy(*by, "pass_id").orderBy(ts)
    nxt = lambda c: F.lead(c).over(w)
    d, b = geo.haversine_m(F.col(lat), F.col(lon), nxt(lat), nxt(lon)), geo.bearing_deg(F.col(lat), F.col(lon), nxt(lat), nxt(lon))
    e = df.select(F.col(key).alias("s"), nxt(key).alias("t"), d.alias("d"), b.alias("b")).where(F.col("t").isNotNull() & (F.col("d") <= most_m))
    two = F.array(F.struct(F.col("s").alias("src"), F.col("t").alias("dst"), F.col("d").alias("distance_m"), F.col("b").alias("bearing_deg")), F.struct(F.col("t").alias("src"), F.col("s").alias("dst"), F.col("d").alias("distance_m"), F.pmod(F.col("b") + 180, F.lit(360.0)).alias("bearing_deg")))
    return e.select(F.inline(two))


def thin_by_distance(df: DataFrame, by: Sequence[str], order: str, step: str, spacing: float) -> DataFrame:
    """Rows at least ``spacing`` of summed ``step`` apart within each group: the sum restarts at each kept row.

    The restart makes this a fold; groups (passes) are short and run in parallel.
    """

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        run, keep = 0.0, []
        for i, d in enumerate(pdf[step].fillna(0.0)):
            run = 0.0 if i == 0 else run + d
            keep.append(i == 0 or run >= spacing)
            if keep[-1]:
                run = 0.0
        return pdf[keep]

    return df.groupBy(*by).applyInPandas(thin, df.schema)


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "total") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def pack_segments(segments: Column, chunk: float, join_gap: float = 0.0) -> Column:
    """Speech intervals array<struct(start, end)> packed into windows of at most ``chunk`` seconds; long ones are cut."""
    item = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    ordered = F.transform(F.array_sort(segments), lambda x: item(x["start"].cast("double"), x["end"].cast("double")))
    none = F.slice(ordered, 1, 0)

    def grow(s: Column, x: Column) -> Column:
        cur = F.try_element_at(s, F.lit(-1))
        joins = (F.size(s) > 0) & (x["start"] - cur["end"] <= join_gap) & (x["end"] - cur["start"] <= chunk)
        return F.when(joins, F.concat(F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1)), F.array(item(cur["start"], x["end"])))).otherwise(F.concat(s, F.array(x)))

    merged = F.aggregate(ordered, none, grow)

    def cut(x: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil((x["end"] - x["start"]) / chunk - 1e-12).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: item(x["start"] + i * chunk, F.least(x["end"], x["start"] + (i + 1) * chunk)))

    return F.filter(F.flatten(F.transform(merged, cut)), lambda x: x["end"] > x["start"])


def chunk_bounds(n: Column, size: int, overlap: int, least: int) -> Column:
    """Windows over [0, n) as array<struct(start, end)>; a short tail goes unless it is the only window."""
    step = max(size - overlap, 1)
    all_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: F.struct(s.alias("start"), F.least(n, s + size).alias("end")))).otherwise(F.array())
    return F.filter(all_, lambda x: (x["end"] - x["start"] >= least) | (x["start"] == 0))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, value: str, out: str) -> DataFrame:
    """Last right value at or before each left row: one union and one window, no range join."""
    cols = [c for c in left.columns]
    r = right.select(*by, F.col(ts), F.col(value).alias(out)).withColumn("_side", F.lit(0))
    u = left.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return u.withColumn(out, F.last(F.when(F.col("_side") == 0, F.col(out)), ignorenulls=True).over(w)).where("_side = 1").select(*cols, out)


def first_crossing(df: DataFrame, by: Sequence[str], layer: str, value: str, least: float) -> DataFrame:
    """First layer over a level, and the first from which all later ones stay over it."""
    over = F.col(value) >= least
    last_under = F.max(F.when(~over, F.col(layer))).over(W.partitionBy(*by))
    d = df.withColumn("_u", last_under)
    return d.groupBy(*by).agg(F.min(F.when(over, F.col(layer))).alias("first_layer"), F.min(F.when(over & (F.col("_u").isNull() | (F.col(layer) > F.col("_u"))), F.col(layer))).alias("sustained_layer"))
