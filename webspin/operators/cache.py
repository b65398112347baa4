"""H1-H4 (and G4's refresh replay): TTL cache policy over a request log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_keys(df: DataFrame, query: str = "query", max_results: str = "max_results",
               extra: list[str] | None = None, out: str = "cache_key") -> DataFrame:
    """H1: md5 of 'query:max_results' (optionally more fields, ':'-joined)."""
    parts = [F.col(query).cast("string"), F.col(max_results).cast("string")] + \
        [F.col(c).cast("string") for c in (extra or [])]
    return df.withColumn(out, F.md5(F.concat_ws(":", *parts)))


TTL_SCHEMA = "key string, event_id long, ts timestamp, hit boolean, stored_at timestamp"


def _ttl_replay(ttl_s: float, store_all: bool):
    def run(batches):
        cur, stored = None, None
        for pdf in batches:
            out_hit, out_stored = [], []
            for k, ts, ok in zip(pdf["key"], pdf["ts"], pdf["_store_ok"]):
                if k != cur:
                    cur, stored = k, None
                hit = stored is not None and (ts - stored).total_seconds() < ttl_s
                if not hit and (store_all or bool(ok)):
                    stored = ts
                out_hit.append(hit)
                out_stored.append(stored)
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "ts": pdf["ts"],
                                "hit": out_hit, "stored_at": pd.Series(out_stored, dtype="object")})
    return run


def ttl_replay(log: DataFrame, key: str, ttl_s: float, success: str | None = None,
               num_partitions: int | None = None) -> DataFrame:
    """Greedy TTL replay per key: hit iff an entry exists and now - stored <
    ttl (strict); on a miss the entry is stored at now (only for successful
    rows when ``success`` is given); a hit does not extend the entry.

    Recursive per key, so not a window: rows are hash partitioned by key,
    sorted by (key, ts, event_id) and streamed batch by batch with one live
    entry per key — no group is materialised whole.
    """
    spark = log.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ok = F.col(success) if success else F.lit(True)
    src = log.select(F.col(key).cast("string").alias("key"), "event_id",
                     F.col("ts").cast("timestamp").alias("ts"), ok.alias("_store_ok"))
    ordered = src.repartition(n, "key").sortWithinPartitions("key", "ts", "event_id")
    return ordered.mapInPandas(_ttl_replay(float(ttl_s), success is None), TTL_SCHEMA)


def cache_hits(log: DataFrame, ttl_s: float = 300.0, key: str = "cache_key",
               success: str = "success") -> DataFrame:
    """H2: which searches a TTL result cache would have answered."""
    return ttl_replay(log, key, ttl_s, success)


def cache_evict(entries: DataFrame, cap: int = 100, key: str = "key",
                stored: str = "stored_at") -> DataFrame:
    """H3: after the last store of each key, keep the ``cap`` most recent
    entries (oldest dropped). Global top-k: TakeOrderedAndProject keeps at
    most ``cap`` rows per task before the final merge."""
    latest = entries.where(F.col(stored).isNotNull()).groupBy(key).agg(F.max(stored).alias(stored))
    return latest.orderBy(F.col(stored).desc(), F.col(key)).limit(cap)


def cache_hit_rate(replayed: DataFrame) -> DataFrame:
    """H4: hits / total (0 when empty)."""
    return replayed.agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits")) \
        .withColumn("hit_rate", F.when(F.col("total") > 0, F.col("hits") / F.col("total"))
                    .otherwise(F.lit(0.0)))


