import datetime as dt

from pyspark.sql import functions as F

from webspin.operators import cache as H
from webspin.operators import search as S
from webspin.operators import sessions as J
from webspin.sources.payloads import parse_requests


def test_engine_fallback_order(spark):
    rows = [
        ("q1", "google_custom", True, 3), ("q1", "searx", True, 5),                 # target usable
        ("q2", "google_custom", False, 0), ("q2", "duckduckgo", True, 2), ("q2", "searx", True, 4),
        ("q3", "google_custom", True, 0), ("q3", "duckduckgo", True, 1),            # target empty
        ("q4", "google_custom", False, 0), ("q4", "searx", False, 0),               # nothing usable
    ]
    df = spark.createDataFrame(rows, "query string, engine string, success boolean, n_results long")
    got = {r.query: (r.engine, r.used_fallback) for r in S.engine_fallback(df, "google_custom").collect()}
    assert got == {"q1": ("google_custom", False), "q2": ("searx", True),
                   "q3": ("duckduckgo", True), "q4": ("google_custom", False)}


def test_cache_cap_keeps_most_recent(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"k{i}", t0 + dt.timedelta(seconds=i)) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, stored_at timestamp")
    kept = {r.key for r in H.cache_evict(df, cap=100).collect()}
    assert kept == {f"k{i}" for i in range(50, 150)}


def test_request_parsing_defaults_and_overrides(spark):
    rows = [('{"query": "spark", "max_results": 3}', None), ("plain words", None), ("{broken", None),
            ('{"query": "x", "query_type": "academic"}', {"max_results": "7"})]
    df = spark.createDataFrame(rows, "raw string, ov map<string,string>")
    got = [(r.query, r.max_results, r.query_type, r.extract_content)
           for r in parse_requests(df, "raw", "ov").collect()]
    assert got == [("spark", 3, "general", True), ("plain words", 10, "general", True),
                   ("{broken", 10, "general", True), ("x", 7, "academic", True)]


def test_session_status_after_two_queries(spark):
    msgs = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "see https://a.org"),
                                  (1, 2, "user", "q2"), (1, 3, "assistant", "done")],
                                 "conv_id long, turn long, role string, text string")
    r = J.session_status(msgs).first()
    assert r.message_count >= 4 and r.sources_found == 1 and r.last_role == "assistant"
    lst = {r.conv_id: r.message_count for r in J.session_list(msgs).collect()}
    assert lst == {1: 4, None: 4}


def test_format_results_text(spark):
    res = spark.createDataFrame([("q", "searx", 1, "T1", "https://a.org", "S1"),
                                 ("q", "searx", 2, "T2", "https://b.org", "S2")],
                                "query string, engine string, rank int, title string, url string, snippet string")
    txt = S.format_results(res).first().formatted
    assert txt == ("Found 2 results for 'q' (via searx):\n\n**1. T1**\nURL: https://a.org\nDescription: S1\n"
                   "\n**2. T2**\nURL: https://b.org\nDescription: S2\n")


def test_relevance_prefers_exact_match(spark):
    df = spark.createDataFrame([("python tutorial", "Python Tutorial", "learn python", 2),
                                ("python tutorial", "Cooking", "recipes", 1)],
                               "query string, title string, snippet string, rank int")
    r = [x.relevance for x in S.relevance(df).collect()]
    assert 0 <= r[1] < r[0] <= 1


def test_domain_filters_are_substring_matches(spark):
    from webspin import dims

    df = spark.createDataFrame([(1, "old.reddit.com"), (2, "en.wikipedia.org"), (3, "example.org")],
                               "page_id long, host string")
    blocked = dims.blocked_domains(spark)
    preferred = dims.preferred_domains(spark)
    assert [r.page_id for r in S.drop_blocked(df, blocked).orderBy("page_id").collect()] == [2, 3]
    assert [r.page_id for r in S.keep_preferred(df, preferred).collect()] == [2]
    pr = {r.page_id: r.priority for r in
          S.domain_priority(df, dims.BLOCKED_DOMAINS, dims.PREFERRED_DOMAINS).collect()}
    assert pr == {1: 0, 2: 10, 3: 5}


def test_robots_rules_and_decisions(spark):
    from webspin.operators import robots as G

    text = ("# comment\nUser-agent: *\nDisallow: /private\nAllow: /private/ok*\nDisallow:\n\n"
            "User-agent: WebSpinBot\nDisallow: /\n")
    rules = G.robots_rules(spark.createDataFrame([("a.org", text)], "domain string, text string"))
    got = sorted((r.agent, r.kind, r.prefix) for r in rules.collect())
    assert got == [("*", "allow", "/private/ok*"), ("*", "disallow", "/private"),
                   ("webspinbot", "disallow", "/")]
    urls = spark.createDataFrame([(1, "a.org", "/private/x"), (2, "a.org", "/private/ok/1"),
                                  (3, "a.org", "/public"), (4, "b.org", "/private")],
                                 "page_id long, domain string, path string")
    star = {r.page_id: r.allowed for r in G.robots_allowed(urls, rules, user_agent="otherbot").collect()}
    assert star == {1: False, 2: True, 3: True, 4: True}
    ours = {r.page_id: r.allowed for r in G.robots_allowed(urls, rules, user_agent="WebSpinBot").collect()}
    assert ours == {1: False, 2: True, 3: False, 4: True}


def test_workflow_continuity(spark):
    rows = [(1, 1, "assistant", "a"), (1, 3, "assistant", "b"),
            (2, 1, "assistant", "same"), (2, 3, "assistant", "same"), (2, 5, "assistant", "x"),
            (3, 1, "assistant", "only one"), (4, 1, "assistant", " "), (4, 3, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.continuity_ok for r in J.workflow_continuity(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
