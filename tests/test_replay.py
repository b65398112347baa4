import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from webspin.operators import cache as H
from webspin.operators import limits as I
from webspin.plans.scan import keyed_prefix


def test_keyed_prefix_matches_window_under_skew(spark):
    random.seed(3)
    rows = [(0 if random.random() < 0.4 else None if random.random() < 0.1 else random.randint(1, 20), i,
             random.randint(-3, 9) if random.random() > 0.05 else None) for i in range(3000)]
    rows += [(None, None, 4), (3, None, 5)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            for op, agg in (("sum", F.sum), ("max", F.max)):
                for inc in (True, False):
                    got = keyed_prefix(df, "k", ["t"], "v", "out", op=op, inclusive=inc, width=100)
                    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0 if inc else -1)
                    exp = df.withColumn("out", agg("v").over(w))
                    if op == "sum":
                        exp = exp.withColumn("out", F.coalesce("out", F.lit(0)))
                    key = lambda r: str(r)
                    assert sorted(got.collect(), key=key) == sorted(exp.collect(), key=key), (op, inc, reuse)
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
    text = spark.createDataFrame([("a", 1, 1), (None, 2, 1), ("", 3, 1), (None, 4, 1)], "k string, t long, v long")
    assert sorted((r.t, r.out) for r in keyed_prefix(text, "k", ["t"], "v", "out", width=1).collect()) == [(1, 1), (2, 1), (3, 1), (4, 2)]


def _log(spark, times, domain="google.com", engine=None):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, domain, engine, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(times)]
    return spark.createDataFrame(rows, "event_id long, identifier long, domain string, engine string, ts timestamp")


def test_replay_shared_keys(spark):
    # one request per 2.5 s; domain limit 10/min + gap 2 s; shared state halves the quota
    log = _log(spark, [i * 2.5 for i in range(24)])
    shared = I.replay_limits(log, shared_keys=True).orderBy("event_id").collect()
    unshared = I.replay_limits(log, shared_keys=False).orderBy("event_id").collect()
    assert sum(r.allowed for r in shared) == 5
    assert sum(r.allowed for r in unshared) == 10
    assert shared[5].counted_block and shared[5].violating_type == "requests_per_minute"


def test_sliding_count_matches_range_frame(spark):
    random.seed(5)
    times = sorted(random.sample(range(0, 20000), 400))
    log = _log(spark, times)
    got = {r.event_id: r.n_in_window for r in I.window_counts(log, 600, 3).collect()}
    for i, s in enumerate(times):
        assert got[i] == sum(1 for t in times[:i] if t > s - 600)


def test_pacing_closed_form(spark):
    times = [0, 0.5, 1, 10, 10.2, 30]
    log = _log(spark, times)
    got = sorted((r.event_id, r.start_s - times[0] - 1704067200) for r in I.pace_requests(log, 2.0).collect())
    start, exp = None, []
    for t in times:
        start = t if start is None else max(t, start + 2.0)
        exp.append(start)
    assert [round(g, 6) for _, g in got] == exp


def test_ttl_cache_replay(spark):
    t0 = dt.datetime(2024, 1, 1)
    secs = [0, 100, 299, 300, 301, 700, 800]
    ok = [True, True, True, True, True, False, True]
    rows = [(i, "k", t0 + dt.timedelta(seconds=s), o) for i, (s, o) in enumerate(zip(secs, ok))]
    df = spark.createDataFrame(rows, "event_id long, cache_key string, ts timestamp, success boolean")
    got = [r.hit for r in H.cache_hits(df, 300.0).orderBy("event_id").collect()]
    assert got == [False, True, True, False, True, False, False]


def test_chat_history_format_and_empty_session(spark):
    from webspin.operators.sessions import NO_HISTORY, chat_history

    msgs = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(8)],
                                 "conv_id long, turn long, role string, text string")
    sessions = spark.createDataFrame([(1,), (2,)], "conv_id long")
    got = {r.conv_id: r.history for r in chat_history(msgs, sessions=sessions).collect()}
    assert got[1] == "\n".join(f"{'Humano' if i % 2 == 0 else 'Asistente'}: m{i}" for i in range(2, 8))
    assert got[2] == NO_HISTORY


def test_fetch_outcomes_paths(spark):
    from webspin.sources.tables import fetch_outcomes

    rows = [("https://a.org/x", 200, "ok", 10), ("https://a.org/y", 404, "nf", 2),
            ("https://a.org/z", 301, "moved", 5), ("", 200, "x", 1),
            ("https://a.org/big", 200, "huge", 20 * 1024 * 1024)]
    df = spark.createDataFrame(rows, "url string, status_code int, content string, declared_length long")
    got = [(r.status_code, r.success, r.error, r.content) for r in fetch_outcomes(df).collect()]
    assert got == [(200, True, None, "ok"), (404, False, "HTTP 404", "nf"), (301, True, None, "moved"),
                   (0, False, "Invalid URL", ""),
                   (200, False, f"Response too large: {20 * 1024 * 1024} bytes", "")]


def test_limit_status_and_idle(spark):
    log = _log(spark, [0, 10, 20, 30, 100000], domain="github.com")
    at = F.lit("2024-01-01 00:00:40").cast("timestamp_ntz")
    st = {(r.scope, r.limit_type): (r.made, r.remaining) for r in I.limit_status(log, at).collect()}
    assert st[("global", "requests_per_minute")] == (4, 96.0)
    assert st[("domain", "requests_per_hour")] == (4, 996.0)
    idle = I.expire_idle(log, F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).first()
    assert not idle.expired and idle.idle_s == 2 * 86400 - 100000   # 72,800 s < one day
    idle = I.expire_idle(log, F.lit("2024-01-04 00:00:00").cast("timestamp_ntz")).first()
    assert idle.expired and idle.idle_s == 3 * 86400 - 100000
