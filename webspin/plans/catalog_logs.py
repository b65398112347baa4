"""Registered queries: rate limits (I1-I11), cache (H1-H4), robots."""

from __future__ import annotations

from pyspark.sql import functions as F

from webspin import dims
from webspin.functions import urls as U
from webspin.operators import cache as H
from webspin.operators import limits as I
from webspin.operators import robots as G
from webspin.plans.asof import as_of
from webspin.sources.derived import request_log, robots, search_log
from webspin.sources.tables import load

# Test parameters: the preset per-minute limits never fire on this log (about
# one request per 4 minutes), so the checks use an hourly window.
WINDOW_S, WINDOW_LIMIT = 3600, 2


def _ntz(c):
    return F.col(c).cast("timestamp_ntz")


def _hourly_limits(spark):
    extra = spark.createDataFrame([("global", "*", "requests_per_hour", float(WINDOW_LIMIT), WINDOW_S)],
                                  dims.rate_limits(spark).schema)
    return dims.rate_limits(spark).unionByName(extra)


def _at(spark, sf):
    # the log's last instant: one scalar taken from the data (as wall-clock
    # text, so the driver's own time zone never enters)
    s = load(spark, sf, "events").agg(F.max("ts").cast("string")).first()[0]
    return F.lit(s).cast("timestamp_ntz")


def q_i1(spark, sf):
    a = I.applicable_limits(request_log(spark, sf))
    return a.select("event_id", "scope", "key", "limit_type", "limit", "window")


def q_i2(spark, sf):
    return I.window_counts(request_log(spark, sf), WINDOW_S, WINDOW_LIMIT) \
        .select("event_id", "identifier", "n_in_window", "violation")


def q_i3(spark, sf):
    return I.gap_violations(request_log(spark, sf), 60.0) \
        .select("event_id", "identifier", "gap_s", "passes")


def q_i4(spark, sf):
    spark_log = request_log(spark, sf)
    r = I.replay_limits(spark_log, _hourly_limits(spark))
    return r.select("event_id", "identifier", "allowed", "counted_block", "violating_type")


def q_i5(spark, sf):
    c = I.window_counts(request_log(spark, sf), WINDOW_S, WINDOW_LIMIT)
    return I.backoff(c, WINDOW_S).select("event_id", "violations_before", "backoff_s")


def q_i6(spark, sf):
    return I.limit_stats(I.replay_limits(request_log(spark, sf), _hourly_limits(spark)))


def q_i7(spark, sf):
    log = request_log(spark, sf)
    s = I.limit_status(log, _at(spark, sf))
    return s.select("identifier", "scope", "key", "limit_type", "limit", "window", "made",
                    "remaining", _ntz("reset_time").alias("reset_time"), "quota_exhausted")


def q_i8(spark, sf):
    log = request_log(spark, sf)
    return I.expire_idle(log, _at(spark, sf)).select("identifier", _ntz("last_ts").alias("last_ts"),
                                               "idle_s", "expired")


def q_i9(spark, sf):
    return I.pace_requests(request_log(spark, sf), 2.0) \
        .select("event_id", "identifier", "arrive_s", "start_s", "wait_s")


def q_i10(spark, sf):
    return I.tool_window_waits(request_log(spark, sf), 1, 60) \
        .select("event_id", "identifier", "n_in_window", "wait_s")


def q_i11(spark, sf):
    ev = load(spark, sf, "events").where(F.col("event_type") == "error").select("event_id")
    return I.retry_schedule(ev, retries=3, base_s=1.0).select("event_id", "attempt", "wait_s")


def q_i11_totals(spark, sf):
    ev = load(spark, sf, "events").where(F.col("event_type") == "error").select("event_id")
    return I.retry_totals(I.retry_schedule(ev, retries=3, base_s=1.0))


def _keyed_search_log(spark, sf):
    return H.cache_keys(search_log(spark, sf).withColumn("max_results", F.lit(10)))


def q_h1(spark, sf):
    return _keyed_search_log(spark, sf).select("event_id", "cache_key")


def q_h2(spark, sf):
    return H.cache_hits(_keyed_search_log(spark, sf), ttl_s=3600.0) \
        .select("key", "event_id", "hit", _ntz("stored_at").alias("stored_at"))


def q_h3(spark, sf):
    rep = H.cache_hits(_keyed_search_log(spark, sf), ttl_s=3600.0)
    return H.cache_evict(rep, cap=100).select("key", _ntz("stored_at").alias("stored_at"))


def q_h4(spark, sf):
    return H.cache_hit_rate(H.cache_hits(_keyed_search_log(spark, sf), ttl_s=3600.0))


def q_g1(spark, sf):
    return G.robots_rules(robots(spark, sf))


def _page_paths(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "url")
    n = U.canonical_url(F.col("url"))
    return p.select("page_id", U.two_label_domain(U.url_host(n)).alias("domain"),
                    U.url_path(n).alias("path"))


def q_g2(spark, sf):
    rules = G.robots_rules(robots(spark, sf)).select(F.col("domain").alias("_rd"), "agent", "kind",
                                                      "prefix", "pos")
    paths = _page_paths(spark, sf)
    j = paths.join(rules, paths["domain"] == rules["_rd"])  # a few rules per domain
    return j.select("page_id", "agent", "kind", "pos",
                    G.path_matches(F.col("path"), F.col("prefix")).alias("matches"))


def q_g3(spark, sf):
    rules = G.robots_rules(robots(spark, sf))
    return G.robots_allowed(_page_paths(spark, sf), rules).select("page_id", "domain", "path", "allowed")


def q_g4(spark, sf):
    log = request_log(spark, sf).withColumn("agent", F.lit("*"))
    r = G.robots_refresh_points(log)
    return r.select("key", "event_id", "refetch")


def q_g5(spark, sf):
    """Robots rules in force at each request: every 97th event fetches its
    domain's robots file, whose rule depends on the version (the event id)."""
    log = request_log(spark, sf)
    states = log.where("event_id % 97 = 0").groupBy("domain", "ts").agg(F.max("event_id").alias("rules_version"))
    states = states.withColumn("prefix", F.concat(F.lit("/p"), (F.col("rules_version") % 3).cast("string")))
    requests = log.select("event_id", "domain", "ts", F.concat(F.lit("/p"), (F.col("event_id") % 3).cast("string")).alias("path"))
    r = as_of(requests, states, "domain", "ts", ["rules_version", "prefix"], fact_time_as="fetched")
    return r.select("event_id", "domain", "rules_version", ((I.micros(F.col("ts")) - I.micros(F.col("fetched"))) / F.lit(1_000_000.0)).alias("age_s"),
                    F.coalesce(~G.path_matches(F.col("path"), F.col("prefix")), F.lit(True)).alias("allowed"))


def q_i12(spark, sf):
    """Quota at each request: every 211th event sets its engine's hourly limit
    (3 until then); what is left of it counts the window before the request."""
    log = request_log(spark, sf)
    settings = log.where("event_id % 211 = 0").groupBy("engine", "ts").agg(F.max("event_id").alias("setting"))
    settings = settings.withColumn("limit", (F.col("setting") % 5 + 1).cast("double"))
    counted = I.window_counts(log, WINDOW_S, WINDOW_LIMIT).select("event_id", "identifier", "engine", "ts", "n_in_window")
    r = as_of(counted, settings, "engine", "ts", ["limit"]).withColumn("limit", F.coalesce("limit", F.lit(3.0)))
    return r.select("event_id", "identifier", "engine", "limit", "n_in_window", F.greatest(F.col("limit") - F.col("n_in_window"), F.lit(0.0)).alias("remaining"))


QUERIES = {
    "I1_applicable_limits": q_i1,
    "I2_window_counts": q_i2,
    "I3_gap_violations": q_i3,
    "I4_replay_limits": q_i4,
    "I5_backoff": q_i5,
    "I6_limit_stats": q_i6,
    "I7_limit_status": q_i7,
    "I8_expire_idle": q_i8,
    "I9_pace_requests": q_i9,
    "I10_tool_window_waits": q_i10,
    "I11_retry_schedule": q_i11,
    "I11_retry_totals": q_i11_totals,
    "H1_cache_keys": q_h1,
    "H2_cache_hits": q_h2,
    "H3_cache_evict": q_h3,
    "H4_cache_hit_rate": q_h4,
    "G1_robots_rules": q_g1,
    "G2_path_matches": q_g2,
    "G3_robots_allowed": q_g3,
    "G5_rules_at_request": q_g5,
    "I12_quota_at_request": q_i12,
    "G4_robots_refresh_points": q_g4,
}
