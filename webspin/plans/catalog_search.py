"""Registered queries: sources (A2-A10) and search-result jobs (F1-F16)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webspin import dims
from webspin.functions import urls as U
from webspin.operators import robots as G
from webspin.operators import search as S
from webspin.plans import corpus, flagship
from webspin.session import ensure_checkpoint_dir
from webspin.functions.tools import register_page_elements
from webspin.sources import payloads as P
from webspin.sources.derived import fetches, ranked_urls, result_urls, robots, search_log, search_results
from webspin.sources.dump import read_dump, write_dump
from webspin.sources.tables import fetch_outcomes, load, write_corpus

BLOCKED = dims.BLOCKED_DOMAINS + dims.TEST_BLOCKED_DOMAINS
PREFERRED = dims.PREFERRED_DOMAINS + dims.TEST_PREFERRED_DOMAINS
QUERY_TYPE_CYCLE = ["general", "academic", "news", "technical", "unknown"]


def _results(spark, sf):
    r = search_results(spark, sf)
    return r.withColumn("host", U.url_host(U.canonical_url(F.col("url"))))


def _hosts(spark, sf):
    return result_urls(spark, sf).withColumn("host", U.url_host(U.canonical_url(F.col("url"))))


def q_a2(spark, sf):
    return fetch_outcomes(fetches(spark, sf)).select(
        "page_id", "status_code", "success", "error", F.length("content").alias("content_len"))


def _serp(spark, sf, engine):
    return P.serp(spark, sf).where(F.col("engine") == engine)


def q_a3(spark, sf):
    return P.parse_google_payloads(_serp(spark, sf, "google_custom")) \
        .select("query", "rank", "title", "url", "cache_id")


def q_a4(spark, sf):
    return P.parse_searx_payloads(_serp(spark, sf, "searx"), 10) \
        .select("query", "rank", "title", "url", "engines", "score")


def q_a5(spark, sf):
    return P.parse_bing_payloads(_serp(spark, sf, "bing")) \
        .select("query", "rank", "title", "url", "display_url")


def q_a6(spark, sf):
    return P.parse_instant_answers(_serp(spark, sf, "instant_answer"), 10) \
        .select("query", "rank", "title", "url", "snippet")


def _raw_requests(spark, sf):
    c = load(spark, sf, "conversations").where(F.col("role") == "user")
    js = F.to_json(F.struct(F.col("text").alias("query"),
                            (F.col("turn") + 1).cast("int").alias("max_results")))
    bad = F.when(F.col("conv_id") % 2 == 0, F.lit("{bad json")).otherwise(F.concat(js, F.lit(" trailing")))
    raw = F.when(F.col("turn") % 3 == 0, js).when(F.col("turn") % 3 == 1, bad)\
        .otherwise(F.col("text"))
    return c.select("conv_id", "turn", raw.alias("raw"))


def q_a8(spark, sf):
    return P.parse_requests(_raw_requests(spark, sf)).select(
        "conv_id", "turn", "query", "max_results", "query_type", "extract_content")


def q_a9(spark, sf):
    return S.format_results(S.top_results(_results(spark, sf), 10).withColumn(
        "engine", F.lit("searx")))


def q_a10(spark, sf):
    cur = corpus.curate_corpus(load(spark, sf, "documents"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    write_corpus(cur, path, partition_by=["source"])
    return spark.read.parquet(path).select("doc_id", "source", "quality", "n_chars")


def q_a1_dump(spark, sf):
    """The fetch log written as a crawl dump, read back, and its outcomes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dump-{uuid.uuid4().hex}"
    write_dump(fetches(spark, sf).withColumn("headers", F.create_map(F.lit("x-page-id"), F.col("page_id").cast("string"))), path)
    read = read_dump(spark, path).withColumn("page_id", F.col("headers")["x-page-id"].cast("long"))
    return fetch_outcomes(read).select("page_id", "status_code", "success", "error", F.length("content").alias("content_len"))


def q_a1_elements(spark, sf):
    """Elements of each page by a registered table function, from SQL."""
    register_page_elements(spark)
    load(spark, sf, "pages").select("page_id", "html").createOrReplaceTempView("_pages_for_elements")
    return spark.sql("""SELECT page_id, e.selector, count(*) AS n_elements
                        FROM _pages_for_elements, LATERAL page_elements(html, array('nav > ul a', 'head title, h1')) e GROUP BY page_id, e.selector""")


def q_f1(spark, sf):
    return S.drop_blocked(_hosts(spark, sf), dims.blocked_domains(spark, dims.TEST_BLOCKED_DOMAINS)) \
        .select("page_id", "host")


def q_f2(spark, sf):
    return S.keep_preferred(_hosts(spark, sf),
                            dims.preferred_domains(spark, dims.TEST_PREFERRED_DOMAINS)) \
        .select("page_id", "host")


def q_f3(spark, sf):
    return S.domain_priority(_hosts(spark, sf), BLOCKED, PREFERRED).select("page_id", "host", "priority")


def q_f4(spark, sf):
    return S.filter_domains(_hosts(spark, sf), ["example.org", "example.net"], ["blog."],
                            dims.blocked_domains(spark, dims.TEST_BLOCKED_DOMAINS)) \
        .select("page_id", "host")


def q_f5(spark, sf):
    return S.relevance(_results(spark, sf)).select("page_id", "query", "relevance")


def q_f6(spark, sf):
    return S.top_results(ranked_urls(spark, sf), 10).select("query", "rank", "page_id")


def _parsed(spark, sf):
    # every engine's payloads parsed in one pass over the payload table
    return P.parse_any_payloads(P.serp(spark, sf), 10)


def _payload_results(spark, sf):
    p = _parsed(spark, sf)
    return p, p.where("valid").select(P.RESULT_COLS)


def q_f7(spark, sf):
    return S.engine_fallback(S.response_summary_parsed(_parsed(spark, sf)), "google_custom")


def q_f7_chain(spark, sf):
    # the instant-answer engine knows English and French only
    instant = P.parse_instant_answers(_serp(spark, sf, "instant_answer"), 10).where(F.substring_index("query", ":", -1).isin("en", "fr"))
    known = instant.groupBy("query").agg(F.count(F.lit(1)).alias("n_results")).select(
        "query", F.lit("instant_answer").alias("engine"), F.lit(True).alias("success"), "n_results")
    others = S.response_summary_parsed(_parsed(spark, sf)).where(F.col("engine") != "instant_answer")
    return S.tool_chain(others.unionByName(known))


def q_f7_mirrors(spark, sf):
    # a document's searx answer comes from mirror doc_id % 3; French queries
    # find the first mirror down, German ones the first two, Spanish ones all
    r = _parsed(spark, sf).where((F.col("engine") == "searx") & F.col("valid"))
    mirror = (F.element_at(F.split("url", "/"), -1).cast("long") % 3).cast("int")
    lang = F.substring_index("query", ":", -1)
    down = F.when(lang == "fr", 1).when(lang == "de", 2).when(lang == "es", 3).otherwise(0)
    answers = r.select("query", mirror.alias("mirror"), down.alias("down")).groupBy("query", "mirror").agg(
        F.count_if(F.col("mirror") >= F.col("down")).alias("n_results"))
    return S.first_mirror(answers)


def q_f9(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    recs = flagship.page_records(pages).select("page_id", "normalized_url", F.col("title").alias("content"))
    rules = G.robots_rules(robots(spark, sf))
    n = U.canonical_url(F.col("url"))
    paths = pages.select("page_id", U.two_label_domain(U.url_host(n)).alias("domain"),
                         U.url_path(n).alias("path"))
    allowed = G.robots_allowed(paths, rules)
    e = S.enrich_results(ranked_urls(spark, sf).select("query", "rank", "url"), recs, allowed)
    return e.select("query", "rank", "normalized_url", (F.col("content").isNotNull()).alias("has_content"),
                    "robots_blocked")


def q_f10(spark, sf):
    r = result_urls(spark, sf)
    qt = F.element_at(F.array(*[F.lit(t) for t in QUERY_TYPE_CYCLE]),
                      (F.col("page_id") % len(QUERY_TYPE_CYCLE) + 1).cast("int"))
    return S.infer_content_type(r.withColumn("query_type", qt), F.col("query_type")) \
        .select("page_id", "query_type", "content_type")


def q_f11(spark, sf):
    c = load(spark, sf, "conversations").where(F.col("role") == "user")
    qt = F.element_at(F.array(*[F.lit(t) for t in QUERY_TYPE_CYCLE]),
                      (F.col("turn") % len(QUERY_TYPE_CYCLE) + 1).cast("int"))
    q = c.select("conv_id", "turn", F.col("text").alias("query"), qt.alias("query_type"))
    e = S.expand_queries(q)
    return e.select("conv_id", "turn", "effective_type", "expanded_query", "max_results",
                    F.array_join("preferred_engines", ",").alias("engines"))


def q_f12(spark, sf):
    s, res = _payload_results(spark, sf)
    return S.valid_results(res).select("query", "engine", "rank", "url")


def q_f13(spark, sf):
    s, res = _payload_results(spark, sf)
    return S.normalize_results(res).select("query", "engine", "rank", "url", "domain")


def q_f14(spark, sf):
    return S.engine_health(search_log(spark, sf))


def q_f15(spark, sf):
    return S.available_engines(search_log(spark, sf))


def q_f16(spark, sf):
    from webspin.operators import cache as H
    from webspin.operators import limits as I
    from webspin.plans.catalog_logs import _hourly_limits
    from webspin.sources.derived import request_log

    log = search_log(spark, sf)
    hits = H.cache_hits(H.cache_keys(log.withColumn("max_results", F.lit(10))), ttl_s=3600.0)
    blocks = I.replay_limits(request_log(spark, sf), _hourly_limits(spark))
    # each event's fetch is the page of its number
    pages = load(spark, sf, "pages").select("page_id", "url")
    n = U.canonical_url(F.col("url"))
    paths = pages.select("page_id", U.two_label_domain(U.url_host(n)).alias("domain"), U.url_path(n).alias("path"))
    decided = G.robots_allowed(paths, G.robots_rules(robots(spark, sf))).select("page_id", "allowed")
    fetched = log.select("event_id", "ts").join(decided, F.col("event_id") == F.col("page_id"))
    return S.tool_stats(log, hits, blocks, fetched)


QUERIES = {
    "A1_crawl_dump": q_a1_dump,
    "A1_page_elements": q_a1_elements,
    "A2_fetch_outcomes": q_a2,
    "A3_parse_google_payloads": q_a3,
    "A4_parse_searx_payloads": q_a4,
    "A5_parse_bing_payloads": q_a5,
    "A6_parse_instant_answers": q_a6,
    "A8_parse_requests": q_a8,
    "A9_format_results": q_a9,
    "A10_write_corpus": q_a10,
    "F1_drop_blocked": q_f1,
    "F2_keep_preferred": q_f2,
    "F3_domain_priority": q_f3,
    "F4_filter_domains": q_f4,
    "F5_relevance": q_f5,
    "F6_top_results": q_f6,
    "F7_engine_fallback": q_f7,
    "F7_tool_chain": q_f7_chain,
    "F7_first_mirror": q_f7_mirrors,
    "F9_enrich_results": q_f9,
    "F10_infer_content_type": q_f10,
    "F11_expand_queries": q_f11,
    "F12_valid_results": q_f12,
    "F13_normalize_results": q_f13,
    "F14_engine_health": q_f14,
    "F15_available_engines": q_f15,
    "F16_tool_stats": q_f16,
}
