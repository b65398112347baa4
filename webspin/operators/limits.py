"""Rate-limit, pacing and retry analytics over a request log.

Closed-form jobs (I2, I3, I5, I7-I11) are joins, aggregates and keyed prefix
scans. The exact accept/deny replay (I4) is recursive per identifier and
runs as a sorted, streaming per-partition replay (see ``replay_limits``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspin import dims
from webspin.plans.scan import keyed_prefix

WINDOW_OF = {"requests_per_minute": 60, "requests_per_hour": 3600, "requests_per_day": 86400}
SCOPE_ORDER = {"global": 0, "domain": 1, "engine": 2}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def applicable_limits(log: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Every limit row that applies to each request: global rows, the
    request domain's rows, the request engine's rows (in that list order).

    The limits table is a bounded dimension: broadcast equi-join on
    (scope, key) after a 3-way explode of the request's keys.
    """
    lim = limits if limits is not None else dims.rate_limits(log.sparkSession)
    keys = F.array(
        F.struct(F.lit("global").alias("scope"), F.lit("*").alias("key"), F.lit(0).alias("scope_pos")),
        F.struct(F.lit("domain").alias("scope"), F.col("domain").alias("key"), F.lit(1).alias("scope_pos")),
        F.struct(F.lit("engine").alias("scope"), F.col("engine").alias("key"), F.lit(2).alias("scope_pos")))
    ex = log.select("*", F.inline(keys))
    # only the built-in table has a known size; a caller's table is left to the optimizer
    return ex.join(F.broadcast(lim) if limits is None else lim, ["scope", "key"], "inner")


def sliding_count(df: DataFrame, key: str, t_us: str, id_col: str, window_s: int,
                  out: str = "n_in_window", oldest: str | None = None) -> DataFrame:
    """Rows of the same key with time in (t - w, t), and the earliest of their
    times with ``oldest``; skew-safe.

    Each row goes to its own time bucket of width w and, as a helper, to the
    next one. All rows that a window can reach are then in its (key, bucket),
    so that one native range window per bucket gives the count: one shuffle, a
    fan-out of two, and a hot key is split by time.
    """
    w_us = int(window_s) * 1_000_000
    bucket = F.floor(F.col(t_us) / F.lit(w_us)).cast("long")
    both = df.withColumn("_own", bucket).withColumn("_b", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(key, "_b").orderBy(t_us).rangeBetween(-(w_us - 1), -1)
    counted = both.withColumn(out, F.count(F.lit(1)).over(w))
    if oldest:
        counted = counted.withColumn(oldest, F.min(t_us).over(w))
    return counted.where(F.col("_b") == F.col("_own")).drop("_own", "_b")


def window_counts(log: DataFrame, window_s: int, limit: float, key: str = "identifier",
                  id_col: str = "event_id") -> DataFrame:
    """Arrivals in the window before each request; violation iff >= limit."""
    base = log.withColumn("_t_us", micros(F.col("ts")))
    c = sliding_count(base, key, "_t_us", id_col, window_s)
    return c.withColumn("violation", F.col("n_in_window") >= F.lit(limit)).drop("_t_us")


def gap_violations(log: DataFrame, min_gap_s: float, key: str = "identifier",
                   id_col: str = "event_id") -> DataFrame:
    """First request passes; later ones need now - previous >= gap."""
    base = log.select(key, id_col, "ts", micros(F.col("ts")).alias("_t_us"))
    prev = keyed_prefix(base, key, ["_t_us", id_col], "_t_us", "_prev_us", op="max", inclusive=False)
    gap = (F.col("_t_us") - F.col("_prev_us")) / F.lit(1_000_000.0)
    return prev.withColumn("gap_s", gap) \
        .withColumn("passes", F.col("gap_s").isNull() | (F.col("gap_s") >= F.lit(float(min_gap_s)))) \
        .drop("_t_us", "_prev_us")


def backoff_delay(window_s: Column, violations: Column, factor: float = dims.BACKOFF_FACTOR,
                  max_delay: float = dims.MAX_DELAY, default_delay: float = dims.DEFAULT_DELAY) -> Column:
    """min(base * factor ** violations, max_delay); base = window or 1 s."""
    base = F.when(window_s > 0, window_s.cast("double")).otherwise(F.lit(default_delay))
    return F.least(base * F.pow(F.lit(factor), violations.cast("double")), F.lit(float(max_delay)))


def backoff(counts: DataFrame, window_s: int, key: str = "identifier",
            id_col: str = "event_id") -> DataFrame:
    """I5 over I2's output: delay a violation would impose, given the number
    of earlier violations of the same identifier."""
    base = counts.select(key, id_col, "ts", "n_in_window", "violation",
                         F.col("violation").cast("long").alias("_v"),
                         micros(F.col("ts")).alias("_t_us"))
    pre = keyed_prefix(base, key, ["_t_us", id_col], "_v", "violations_before", op="sum",
                       inclusive=False)
    return pre.withColumn("backoff_s", backoff_delay(F.lit(window_s), F.col("violations_before"))) \
        .drop("_v", "_t_us")


def limit_status(log: DataFrame, at: Column, limits: DataFrame | None = None) -> DataFrame:
    """Per identifier and applicable windowed limit, requests made in the
    window ending at ``at``, remaining quota, window reset time, and
    quota_exhausted (made >= limit). A limit without requests in its window has
    a row too: made 0, the whole quota, no reset time."""
    lim = (limits if limits is not None else dims.rate_limits(log.sparkSession)) \
        .where(F.col("window") > 0)
    app = applicable_limits(log, lim)
    at_us = micros(at)
    t_us = micros(F.col("ts"))
    inside = (t_us <= at_us) & (t_us > at_us - F.col("window").cast("long") * F.lit(1_000_000))
    g = app.groupBy("identifier", "scope", "key", "limit_type", "limit", "window").agg(
        F.count_if(inside).alias("made"), F.min(F.when(inside, F.col("ts"))).alias("window_start"))
    return g.select(
        "identifier", "scope", "key", "limit_type", "limit", "window", "made",
        F.greatest(F.col("limit") - F.col("made"), F.lit(0.0)).alias("remaining"),
        (F.col("window_start") + F.make_interval(secs=F.col("window").cast("decimal(18,6)")))
        .alias("reset_time"),
        (F.col("made") >= F.col("limit")).alias("quota_exhausted"))


def expire_idle(log: DataFrame, at: Column, idle_s: int = 86400, key: str = "identifier") -> DataFrame:
    """I8: keys whose last request is older than ``idle_s`` at ``at``."""
    g = log.groupBy(key).agg(F.max("ts").alias("last_ts"))
    age = (micros(at) - micros(F.col("last_ts"))) / F.lit(1_000_000.0)
    return g.withColumn("idle_s", age).withColumn("expired", F.col("idle_s") > F.lit(float(idle_s)))


def pace_requests(log: DataFrame, gap_s: float = 2.0, key: str = "identifier",
                  id_col: str = "event_id") -> DataFrame:
    """start_i = i*gap + max_{j<=i}(arrive_j - j*gap) — each start at
    least ``gap`` after the previous one. Two skew-safe prefix scans."""
    base = log.select(key, id_col, micros(F.col("ts")).alias("_t_us"),
                      F.lit(1).cast("long").alias("_one"))
    idx = keyed_prefix(base, key, ["_t_us", id_col], "_one", "_i", op="sum", inclusive=False)
    arrive = F.col("_t_us") / F.lit(1_000_000.0)
    a = idx.withColumn("arrive_s", arrive) \
        .withColumn("_a", F.col("arrive_s") - F.col("_i") * F.lit(float(gap_s)))
    m = keyed_prefix(a, key, ["_t_us", id_col], "_a", "_m", op="max", inclusive=True)
    start = F.col("_i") * F.lit(float(gap_s)) + F.col("_m")
    return m.withColumn("start_s", start).withColumn("wait_s", F.col("start_s") - F.col("arrive_s")) \
        .drop("_t_us", "_one", "_i", "_a", "_m")


def tool_window_waits(log: DataFrame, n: int, window_s: int = 60, key: str = "identifier",
                      id_col: str = "event_id") -> DataFrame:
    """If n earlier calls lie in the last window, wait until the oldest
    of them leaves; the logged stamp is the pre-wait time. One skew-safe
    prefix scan gives the count; the oldest call is a rank lookup."""
    base = log.withColumn("_t_us", micros(F.col("ts")))
    c = sliding_count(base, key, "_t_us", id_col, window_s, oldest="_oldest_us")
    wait = F.lit(float(window_s)) - (F.col("_t_us") - F.col("_oldest_us")) / F.lit(1_000_000.0)
    return c.withColumn("wait_s", F.when(F.col("n_in_window") >= n, F.greatest(wait, F.lit(0.0)))
                        .otherwise(F.lit(0.0))).drop("_oldest_us", "_t_us")


def retry_schedule(df: DataFrame, retries: int = 3, base_s: float = 1.0) -> DataFrame:
    """Attempt k waits base * 2**k before the next one; retries + 1
    attempts; total wait per request (failed requests only)."""
    att = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(retries))).alias("attempt"))
    att = att.withColumn("wait_s", F.when(F.col("attempt") < retries,
                                          F.lit(base_s) * F.pow(F.lit(2.0), F.col("attempt")))
                         .otherwise(F.lit(0.0)))
    return att


def retry_totals(schedule: DataFrame, id_col: str = "event_id") -> DataFrame:
    """I11 per request: attempts made and the total wait before giving up."""
    return schedule.groupBy(id_col).agg(F.count(F.lit(1)).alias("attempts"),
                                        F.sum("wait_s").alias("total_wait_s"))


# ---- I4: exact replay ------------------------------------------------------

REPLAY_SCHEMA = ("event_id long, identifier long, domain string, engine string, ts timestamp, "
                 "allowed boolean, counted_block boolean, blocked_until double, violating_type string")


class Limiter:
    """The limiter's per-identifier state machine, shared by
    the batch replay and the streaming state. State is a dict keyed by limit
    type (shared keys) or by limit row; it serialises to JSON."""

    def __init__(self, limit_rows: list, shared_keys: bool = True,
                 default_delay: float = dims.DEFAULT_DELAY, states: dict | None = None):
        self.limits, self.shared, self.default_delay = limit_rows, shared_keys, default_delay
        self.states = states or {}

    def _key(self, i, lim):
        return lim["limit_type"] if self.shared else "|".join(
            [lim["limit_type"], lim["scope"], lim["key"], str(i)])

    def _state(self, i, lim):
        return self.states.setdefault(self._key(i, lim),
                                      {"ts": [], "last": 0.0, "viol": 0, "blocked": None})

    @staticmethod
    def _check(lim, st, now):
        ltype = lim["limit_type"]
        if ltype in WINDOW_OF:
            cutoff = now - WINDOW_OF[ltype]
            st["ts"] = [t for t in st["ts"] if t > cutoff]
            return len(st["ts"]) < lim["limit"]
        if ltype == "delay_between_requests":
            return st["last"] == 0 or now - st["last"] >= lim["limit"]
        return True  # concurrent_requests always passes

    def step(self, domain, engine, now: float):
        """One request: (allowed, counted_block, blocked_until, violating_type)."""
        applicable = [l for l in self.limits if l["scope"] == "global"
                      or (l["scope"] == "domain" and l["key"] == domain)
                      or (l["scope"] == "engine" and l["key"] == engine)]
        # list order: global, then the domain's, then the engine's (stable)
        applicable.sort(key=lambda l: SCOPE_ORDER[l["scope"]])
        for i, lim in enumerate(applicable):
            st = self._state(i, lim)
            if st["blocked"] is not None and now < st["blocked"]:
                return False, False, st["blocked"], None
            if not self._check(lim, st, now):
                base = lim["window"] if lim["window"] > 0 else self.default_delay
                delay = min(base * (dims.BACKOFF_FACTOR ** st["viol"]), dims.MAX_DELAY)
                st["blocked"] = now + delay
                st["viol"] += 1
                return False, True, st["blocked"], lim["limit_type"]
        for i, lim in enumerate(applicable):
            st = self._state(i, lim)
            st["last"], st["viol"], st["blocked"] = now, 0, None
            if lim["limit_type"] in WINDOW_OF:
                st["ts"].append(now)
                st["ts"] = [t for t in st["ts"] if t > now - 86400]
        return True, False, None, None

    def to_json(self) -> str:
        import json

        return json.dumps(self.states)

    @classmethod
    def from_json(cls, text: str | None, limit_rows, shared_keys=True, default_delay=dims.DEFAULT_DELAY):
        import json

        return cls(limit_rows, shared_keys, default_delay, json.loads(text) if text else {})


REPLAY_COLS = ["event_id", "identifier", "domain", "engine", "ts", "allowed", "counted_block",
               "blocked_until", "violating_type"]


def _replay_partition(limit_rows: list, shared_keys: bool, default_delay: float):
    """Returns a mapInPandas function replaying the limiter over sorted rows."""

    def run(batches):
        lim, cur_ident = None, object()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.identifier != cur_ident:  # state is per identifier
                    lim, cur_ident = Limiter(limit_rows, shared_keys, default_delay), r.identifier
                allowed, counted, until, vtype = lim.step(r.domain, r.engine, r.ts.timestamp())
                out.append((r.event_id, r.identifier, r.domain, r.engine, r.ts, allowed, counted,
                            until, vtype))
            yield pd.DataFrame(out, columns=REPLAY_COLS)
    return run


def replay_limits(log: DataFrame, limits: DataFrame | None = None, shared_keys: bool = True,
                  num_partitions: int | None = None) -> DataFrame:
    """I4: full accept/deny replay of the limiter (rules in SURVEY 2.K).

    The decision at each request depends on the previous decisions of the
    same identifier, so it cannot be a window function. Rows are hash
    partitioned by identifier and sorted by (identifier, ts, event_id); each
    task streams its Arrow batches and keeps only the live state of the
    current identifier (timestamps of the last 24 h), so no group is ever
    materialised whole. The limits table is a bounded dimension (collected
    once to the driver and shipped in the closure).
    """
    spark = log.sparkSession
    lim = limits if limits is not None else dims.rate_limits(spark)
    limit_rows = [r.asDict() for r in lim.collect()]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = log.select("event_id", "identifier", "domain", "engine",
                     F.col("ts").cast("timestamp").alias("ts"))
    ordered = src.repartition(n, "identifier").sortWithinPartitions("identifier", "ts", "event_id")
    return ordered.mapInPandas(_replay_partition(limit_rows, shared_keys, dims.DEFAULT_DELAY),
                               REPLAY_SCHEMA)


def limit_stats(replayed: DataFrame) -> DataFrame:
    """Allowed, blocked, counted violations by domain (a request denied
    inside a running block is blocked but not counted)."""
    return replayed.groupBy("domain").agg(
        F.count_if("allowed").alias("allowed"),
        F.count_if(~F.col("allowed")).alias("blocked"),
        F.count_if("counted_block").alias("violations"))

