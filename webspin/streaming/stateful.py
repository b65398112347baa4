"""Keyed state over streams with ``transformWithState``: exact forms of I2, I8
and J1. State per key is bounded by what the result needs: one time (I8), the
rows of two windows (I2), ``n`` messages (J1). The state store must be RocksDB
(``use_rocksdb``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from webspin.operators.sessions import _history_line

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class IdleKeys(StatefulProcessor):
    """The last time of each key; a timer drops the key once the watermark is
    more than ``idle_us`` past it, and says so."""

    def __init__(self, key: str, idle_us: int):
        self.key, self.idle_us = key, idle_us

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        newest = max(int(pdf["at_us"].max()) for pdf in rows)
        if not self.last.exists() or newest > self.last.get()[0]:
            self.last.update((newest,))
            self.handle.registerTimer((newest + self.idle_us) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and expiredTimerInfo.getExpiryTimeInMs() > (self.last.get()[0] + self.idle_us) // 1000:
            yield pd.DataFrame({self.key: [key[0]], "last_us": [self.last.get()[0]], "dropped_at_ms": [expiredTimerInfo.getExpiryTimeInMs()]})
            self.last.clear()

    def close(self):
        pass


def _timed(stream: DataFrame, watermark: str) -> DataFrame:
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return s.withColumn("at_us", F.unix_micros("ts"))


def expire_idle_stream(stream: DataFrame, idle_s: int = 86400, key: str = "identifier", watermark: str = "1 hour") -> DataFrame:
    """I8 as a stream: (key, last_ts, dropped_at) when a key has been idle for
    more than ``idle_s``; its state is gone then. A key that comes back starts anew."""
    s = _timed(stream, watermark).select(key, "ts", "at_us")
    kind = stream.schema[key].dataType.simpleString()
    out = s.groupBy(key).transformWithStateInPandas(IdleKeys(key, int(idle_s) * 1_000_000), f"{key} {kind}, last_us long, dropped_at_ms long", "append", "eventTime")
    return out.select(key, F.timestamp_micros("last_us").alias("last_ts"), F.timestamp_millis("dropped_at_ms").alias("dropped_at"))


class WindowCounts(StatefulProcessor):
    """Rows by time bucket of the window's width. When the watermark passes a
    bucket's end, its rows have all come: they are counted against it and the
    bucket before, which is then dropped."""

    def __init__(self, key: str, window_us: int):
        self.key, self.window = key, window_us

    def init(self, handle):
        self.handle = handle
        self.rows = handle.getMapState("rows", "bucket long", "times array<bigint>, ids array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        come: dict[int, list] = {}
        for pdf in rows:
            for us, i in zip(pdf["at_us"].tolist(), pdf["row_id"].tolist()):
                come.setdefault(us // self.window, []).append((us, i))
        for bucket, new in come.items():
            if (bucket + 1) * self.window <= watermark:
                continue  # later than the watermark allows
            times, ids = self.rows.getValue((bucket,)) if self.rows.containsKey((bucket,)) else ([], [])
            self.rows.updateValue((bucket,), ([*times, *[t for t, _ in new]], [*ids, *[i for _, i in new]]))
            for later in (1, 2):
                self.handle.registerTimer((bucket + later) * self.window // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        bucket = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.window - 1
        before = self.rows.getValue((bucket - 1,))[0] if self.rows.containsKey((bucket - 1,)) else []
        if self.rows.containsKey((bucket,)):
            times, ids = self.rows.getValue((bucket,))
            t = np.array(times, np.int64)
            every = np.sort(np.concatenate([np.array(before, np.int64), t]))
            n = np.searchsorted(every, t, "left") - np.searchsorted(every, t - self.window, "right")
            yield pd.DataFrame({self.key: [key[0]] * len(t), "row_id": ids, "at_us": t, "n_in_window": n})
        if self.rows.containsKey((bucket - 1,)):
            self.rows.removeKey((bucket - 1,))

    def close(self):
        pass


def window_counts_stream(stream: DataFrame, window_s: int, limit: float, key: str = "identifier", id_col: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """I2 as a stream, row by row as the batch form: arrivals of the key in
    (t - window, t), also where rows come out of order (within the watermark).
    (key, id, ts, n_in_window, violation)"""
    s = _timed(stream, watermark).select(key, "ts", "at_us", F.col(id_col).cast("long").alias("row_id"))
    kind = stream.schema[key].dataType.simpleString()
    out = s.groupBy(key).transformWithStateInPandas(WindowCounts(key, int(window_s) * 1_000_000), f"{key} {kind}, row_id long, at_us long, n_in_window long", "append", "eventTime")
    return out.select(key, F.col("row_id").alias(id_col), F.timestamp_micros("at_us").alias("ts"), "n_in_window", (F.col("n_in_window") >= F.lit(limit)).alias("violation"))


class SessionMemory(StatefulProcessor):
    """The last ``n`` lines of a conversation by their order."""

    def __init__(self, key: str, n: int, ttl_ms: int):
        self.key, self.n, self.ttl_ms = key, n, ttl_ms

    def init(self, handle):
        self.lines = handle.getValueState("lines", "orders array<bigint>, lines array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = list(zip(*self.lines.get())) if self.lines.exists() else []
        for pdf in rows:
            held += zip(pdf["line_order"].tolist(), pdf["line_text"].tolist())
            held = sorted(held)[-self.n:]
        self.lines.update(([o for o, _ in held], [line for _, line in held]))
        yield pd.DataFrame({self.key: [key[0]], "history": ["\n".join(line for _, line in held)]})

    def close(self):
        pass


def chat_history_stream(stream: DataFrame, n: int = 6, key: str = "conv_id", order: str = "turn", ttl_s: int = 86400) -> DataFrame:
    """J1 as a stream: after each batch, the history string (last ``n`` messages)
    of every conversation that has new ones. A conversation without messages
    for ``ttl_s`` is forgotten. Update mode."""
    s = stream.select(key, F.col(order).cast("long").alias("line_order"), _history_line(F.col("role"), F.col("text")).alias("line_text"))
    kind = stream.schema[key].dataType.simpleString()
    return s.groupBy(key).transformWithStateInPandas(SessionMemory(key, n, int(ttl_s) * 1000), f"{key} {kind}, history string", "update", "processingTime")
