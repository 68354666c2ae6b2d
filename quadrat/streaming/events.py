"""Windowed and stateful stream processing; every function takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(path)


def _marked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str] = (), late: str | None = None, value: str | None = None) -> DataFrame:
    return sliding(df, ts, size, size, keys, late, value)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str] = (), late: str | None = None, value: str | None = None) -> DataFrame:
    """window_start, window_end, keys, n and the sum of ``value``."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    g = _marked(df, ts, late).groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *(["total"] if value else []))


def gap_sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """session_start, session_end (last event plus the gap), keys, n."""
    g = _marked(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def once_per_key(df: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    """First arrival of each key; on a stream, state is kept as long as lateness allows."""
    m = _marked(df, ts, late)
    return m.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else m.dropDuplicates(list(keys))


def rule_sessions(df: DataFrame, key: str, ts: str, x: str, y: str, gap_s: float, gap_m: float, late: str = "1 minute") -> DataFrame:
    """Sessions that a pause or a jump ends, as a stateful operator: key, session, started, ended, n.

    State a key: the open session and the last position. Output is appended when a session closes.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s, a, b, _, _, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "session": [s], "started": [pd.Timestamp(a, unit="us")], "ended": [pd.Timestamp(b, unit="us")], "n": [n]})
            return
        cur = state.get if state.exists else None
        out = []
        rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
        for t, px, py in zip(rows[ts].astype("datetime64[us]").astype("int64"), rows[x], rows[y]):
            if cur is None:
                cur = (0, t, t, px, py, 1)
            elif t - cur[2] > gap_s * 1e6 or ((px - cur[3]) ** 2 + (py - cur[4]) ** 2) ** 0.5 > gap_m:
                out.append((k[0], cur[0], cur[1], cur[2], cur[5]))
                cur = (cur[0] + 1, t, t, px, py, 1)
            else:
                cur = (cur[0], cur[1], max(t, cur[2]), px, py, cur[5] + 1)
        if cur:
            state.update(tuple(float(v) if i in (3, 4) else int(v) for i, v in enumerate(cur)))
            state.setTimeoutTimestamp(max(int(cur[2] / 1000 + gap_s * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(a, b, pd.Timestamp(c, unit="us"), pd.Timestamp(d, unit="us"), n) for a, b, c, d, n in out], columns=[key, "session", "started", "ended", "n"])

    kind = df.schema[key].dataType.simpleString()
    return _marked(df, ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, session long, started timestamp, ended timestamp, n long", "session long, a long, b long, x double, y double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Exactly-once Parquet sink of whatever has arrived."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def to_parts(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], change: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Idempotent parts: a batch that is replayed overwrites its own part and nothing else."""

    def put(batch: DataFrame, number: int) -> None:
        change(batch).dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{path}/part={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(df: DataFrame, name: str, mode: str = "complete"):
    """Bounded results to a queryable table, for tests and consoles."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
