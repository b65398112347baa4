"""Whole texts, whole URLs and rows that must not multiply or vanish."""

import os
import subprocess
import sys
import datetime as dt

import pytest
from pyspark.sql import functions as F

from webspin.functions import urls as U
from webspin.operators import limits as I
from webspin.operators import search as S
from webspin.operators import sessions as J
from webspin.operators import urls as OU
from webspin.plans import corpus
from webspin.session import ensure_checkpoint_dir
from webspin.sources import payloads as P


def test_equal_short_hashes_keep_both_urls(spark, monkeypatch):
    monkeypatch.setattr(U, "url_hash", lambda c: F.substring(F.lit("0123456789ab"), 1, 12))
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://a.org/y"), (3, "http://a.org/x")], "page_id long, url string")
    assert sorted(r.page_id for r in OU.dedupe_urls(df).collect()) == [1, 2]


def test_requests_with_trailing_text_are_plain(spark):
    raws = ['{"query":"x"} trailing', '{"query":"x"}', '{"query":"x"},{"query":"y"}', "{bad", ' {"query":"z","max_results":3} ', None, "plain ] text"]
    got = P.parse_requests(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()
    assert [r.query for r in got] == [raws[0], "x", raws[2], "{bad", "z", None, "plain ] text"]
    assert [r.max_results for r in got] == [10, 10, 10, 10, 3, 10, 10]


def test_payloads_hold_whole_texts(spark, tmp_path):
    long = "A first line of a text. " * 40 + "\nsecond line"
    spark.createDataFrame([(3, long, "en", "s", len(long))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    payloads = P.serp(spark, str(tmp_path))
    assert all("second line" in r.payload for r in payloads.collect())
    google = P.parse_google_payloads(payloads.where("engine = 'google_custom'")).first()
    assert google.title == long.split("\n")[0].strip()


def test_enriched_results_do_not_multiply(spark):
    results = spark.createDataFrame([("q", 1, "http://a.org/p"), ("q", 2, "http://a.org/none")], "query string, rank int, url string")
    n = U.canonical_url(F.lit("http://a.org/p"))
    pages = spark.createDataFrame([(7, "second"), (5, "first")], "page_id long, content string").withColumn("normalized_url", n)
    allowed = spark.createDataFrame([(5, True), (7, False)], "page_id long, allowed boolean")
    got = sorted(S.enrich_results(results, pages, allowed).collect(), key=lambda r: r.rank)
    assert [(r.rank, r.content, r.robots_blocked) for r in got] == [(1, "first", False), (2, None, False)]


def test_limits_without_requests_have_a_row(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, 9, "nowhere.org", "searx", t0), (2, 9, "nowhere.org", "searx", t0 + dt.timedelta(hours=5))],
                                "event_id long, identifier long, domain string, engine string, ts timestamp")
    lim = spark.createDataFrame([("global", "*", "per_minute", 1.0, 60), ("global", "*", "per_day", 9.0, 86400), ("domain", "nowhere.org", "per_hour", 4.0, 3600), ("domain", "other.org", "per_hour", 4.0, 3600)],
                                "scope string, key string, limit_type string, limit double, window int")
    at = F.lit("2024-01-01 05:00:30").cast("timestamp")
    got = {(r.scope, r.limit_type): (r.made, r.remaining, r.quota_exhausted) for r in I.limit_status(log, at, lim).collect()}
    assert got == {("global", "per_minute"): (1, 0.0, True), ("global", "per_day"): (2, 7.0, False), ("domain", "per_hour"): (1, 3.0, False)}
    later = F.lit("2024-01-01 09:00:00").cast("timestamp")
    by = {(r.scope, r.limit_type): r for r in I.limit_status(log, later, lim).collect()}
    assert by["global", "per_minute"].made == 0 and by["global", "per_minute"].reset_time is None and len(by) == 3


def test_result_cap_is_an_error(spark):
    df = spark.createDataFrame([("q", 1, "u")], "query string, rank int, url string")
    with pytest.raises(ValueError, match="cap"):
        S.top_results(df, 51)
    assert S.top_results(df, 51, hard_cap=100).count() == 1


def test_frontier_and_graph_count_links_and_pages(spark):
    html = '<a href="/x?utm_source=1">1</a><a href="/x">2</a><a href="http://b.org/">3</a><a href="/p1">4</a>'
    pages = spark.createDataFrame([(1, "http://a.org/p1", html), (2, "http://a.org/p2", html), (3, "http://c.org/", "no links")], "page_id long, url string, html string")
    got = {r.dst_url: (r.n_refs, r.n_pages) for r in corpus.crawl_frontier(pages).collect()}
    edges = OU.raw_links(pages).select("page_id", U.canonical_url(F.col("link")).alias("d")).collect()
    fetched = {r[0] for r in pages.select(U.canonical_url(F.col("url"))).collect()}
    want = {d: (sum(e.d == d for e in edges), len({e.page_id for e in edges if e.d == d})) for d in {e.d for e in edges} - fetched}
    assert got == want and any(a > b for a, b in got.values())
    graph = {(r.src_host, r.dst_host): (r.n_links, r.n_pages) for r in corpus.link_graph(pages).collect()}
    assert graph["a.org", "b.org"] == (2, 2) and graph["a.org", "a.org"] == (6, 2)


def test_history_across_blocks(spark):
    rows = [(0 if i % 3 else None, i * 7, "user" if i % 2 else "assistant", f"m{i}") for i in range(3500)]
    msgs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.history.count("\n") + 1 for r in J.history_at_turn(msgs, 6).collect()}
    want = {}
    for key in (0, None):
        mine = [r for r in rows if r[0] == key]
        want.update({(key, r[1]): min(6, i + 1) for i, r in enumerate(mine) if r[2] == "user"})
    assert got == want
    lines = {(r.conv_id, r.turn): r.history for r in J.history_at_turn(msgs, 6).where("conv_id = 0").collect()}
    mine = [r for r in rows if r[0] == 0]
    k = next(i for i, r in enumerate(mine) if i >= 1025 and r[2] == "user")
    assert [x.split(": ")[1] for x in lines[0, mine[k][1]].split("\n")] == [r[3] for r in mine[k - 5:k + 1]]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="share"):
        ensure_checkpoint_dir(Session())


def test_python_stages_find_the_package_from_elsewhere(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", "{repo}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["D0_prune_dom"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows " in done.stdout, done.stderr[-2000:]
