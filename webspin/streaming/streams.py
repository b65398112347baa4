"""Structured Streaming forms, all driven by a readStream
source with watermarks; tested with ``trigger(availableNow=True)`` on a
parquet directory.

* ``cache_hits_stream``: H2 as keyed state (``applyInPandasWithState``), the
  entry expires by event-time timeout at stored + ttl.
* ``window_counts_stream``: I2's sliding count approximated by event-time
  windows (exact form: the batch job or the state below).
* ``daily_tool_stats_stream`` / ``session_metrics_stream``: F16 per day and
  J6 per session window.
* ``dedupe_urls_stream``: U8 with ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webspin.functions import urls as U

CACHE_OUT = "key string, event_id long, ts timestamp, hit boolean"
CACHE_STATE = "stored double"


def _cache_state_fn(ttl_s: float):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        frames = [p for p in pdfs]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["ts", "event_id"])
        hits = []
        for ts, ok in zip(pdf["ts"], pdf["_store_ok"]):
            now = pd.Timestamp(ts).timestamp()
            hit = stored is not None and now - stored < ttl_s
            if not hit and bool(ok):
                stored = now
            hits.append(hit)
        if stored is not None:
            state.update((stored,))
            state.setTimeoutTimestamp(int((stored + ttl_s) * 1000))
        yield pd.DataFrame({"key": pdf["key"].astype(str), "event_id": pdf["event_id"],
                            "ts": pdf["ts"], "hit": hits})
    return fn


def cache_hits_stream(stream: DataFrame, key: str, ttl_s: float = 300.0, success: str = "success",
                      watermark: str = "1 hour") -> DataFrame:
    """H2 streaming: per key state = last stored time; rows older than the
    watermark are dropped; inside a micro-batch rows are sorted by time."""
    src = stream.select(F.col(key).cast("string").alias("key"), "event_id",
                        F.col("ts").cast("timestamp").alias("ts"), F.col(success).alias("_store_ok")) \
        .withWatermark("ts", watermark)
    return src.groupBy("key").applyInPandasWithState(
        _cache_state_fn(float(ttl_s)), CACHE_OUT, CACHE_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def window_counts_stream(stream: DataFrame, key: str = "user_id", window: str = "60 seconds",
                         slide: str = "10 seconds", watermark: str = "60 seconds") -> DataFrame:
    """I2 streaming approximation: sliding event-time windows per key."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return s.groupBy(F.col(key), F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"))


def daily_tool_stats_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """F16 streaming: per day totals and failures."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return s.groupBy(F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") != "error").alias("successful"))


def session_metrics_stream(stream: DataFrame, gap: str = "30 minutes",
                           watermark: str = "1 hour") -> DataFrame:
    """J6 streaming: step metrics per user session window."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return s.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("actions"),
        F.count_if(F.col("event_type") != "error").alias("steps"))


def dedupe_urls_stream(stream: DataFrame, url_col: str = "url", watermark: str = "1 hour") -> DataFrame:
    """U8 streaming: first arrival per canonical URL within the watermark."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")) \
        .withColumn("normalized_url", U.canonical_url(F.col(url_col))) \
        .withColumn("url_hash", U.url_hash(F.col("normalized_url"))) \
        .withWatermark("ts", watermark)
    return s.dropDuplicatesWithinWatermark(["normalized_url"])


REPLAY_OUT = ("event_id long, identifier long, domain string, engine string, ts timestamp, "
              "allowed boolean, counted_block boolean, blocked_until double, violating_type string")


def _limiter_state_fn(limit_rows, shared_keys, idle_s):
    from webspin.operators.limits import REPLAY_COLS, Limiter

    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:  # I8: idle identifiers expire
            state.remove()
            return
        lim = Limiter.from_json(state.get[0] if state.exists else None, limit_rows, shared_keys)
        frames = [p for p in pdfs]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["ts", "event_id"])
        out, last = [], None
        for r in pdf.itertuples(index=False):
            now = pd.Timestamp(r.ts).timestamp()
            allowed, counted, until, vtype = lim.step(r.domain, r.engine, now)
            out.append((r.event_id, r.identifier, r.domain, r.engine, r.ts, allowed, counted, until, vtype))
            last = now
        state.update((lim.to_json(),))
        state.setTimeoutTimestamp(int((last + idle_s) * 1000))
        yield pd.DataFrame(out, columns=REPLAY_COLS)
    return fn


def replay_limits_stream(stream: DataFrame, limit_rows: list, shared_keys: bool = True,
                         watermark: str = "1 hour", idle_s: int = 86400) -> DataFrame:
    """I4 streaming (with I8): the limiter state per identifier lives in
    Spark state as JSON; identifiers idle for ``idle_s`` expire by event-time
    timeout. Rows older than the watermark are dropped."""
    src = stream.select("event_id", "identifier", "domain", "engine",
                        F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return src.groupBy("identifier").applyInPandasWithState(
        _limiter_state_fn(limit_rows, shared_keys, idle_s), REPLAY_OUT, "state string", "append",
        GroupStateTimeout.EventTimeTimeout)
