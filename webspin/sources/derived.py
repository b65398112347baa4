"""Derived tables (FIXTURES.md section 3), built by Spark from the driver
tables so their size grows with them. Each is a plain projection or join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspin import dims
from webspin.functions import text as X
from webspin.functions import urls as U
from webspin.plans.scan import IDS, keyed_prefix
from webspin.sources.tables import load

TITLE_RE = "(?is)<title[^>]*>(.*?)</title>"
LANG_SEGMENT_RE = "^https?://[^/]+/([a-z]{2})/"


def _engine_of_event(col: str = "event_type"):
    m = None
    for ev, eng in dims.EVENT_ENGINE:
        m = F.when(F.col(col) == ev, F.lit(eng)) if m is None else m.when(F.col(col) == ev, F.lit(eng))
    return m.otherwise(F.lit("duckduckgo"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Agent step log: session = user_id, tool = event_type, ok = not error."""
    ev = load(spark, sf, "events")
    return ev.select(
        F.col("user_id").alias("session_id"), "event_id", "ts",
        F.col("event_type").alias("tool"),
        (F.col("event_type") != "error").alias("success"),
        F.col("props").alias("tool_input"), F.col("value"))


def search_log(spark: SparkSession, sf: str) -> DataFrame:
    """Search log: one search per event; errors are failed searches."""
    ev = load(spark, sf, "events")
    return ev.select(
        "event_id", "ts", F.col("user_id").alias("identifier"),
        F.col("event_type").alias("query"),
        _engine_of_event().alias("engine"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("search_time"),
        F.get_json_object("props", "$.k").cast("int").alias("result_count"))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Request log for the limiter: identifier, preset domain, engine, UTC ts."""
    ev = load(spark, sf, "events")
    doms = dims.PRESET_DOMAINS
    dom = F.element_at(F.array(*[F.lit(d) for d in doms]),
                       (F.col("user_id") % len(doms) + 1).cast("int"))
    return ev.select(
        "event_id", F.col("user_id").alias("identifier"), dom.alias("domain"),
        _engine_of_event().alias("engine"),
        F.col("ts").cast("timestamp").alias("ts"))


def result_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The search results' page_id, query and url: all that jobs need which
    look at neither rank nor text (the html is never read)."""
    p = load(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", F.regexp_extract("url", LANG_SEGMENT_RE, 1).alias("query"), "url")


def ranked_urls(spark: SparkSession, sf: str) -> DataFrame:
    """result_urls with the rank by page_id within the query. A query (a
    language) holds a large share of all pages, so the rank is a bucketed
    running count."""
    ranked = keyed_prefix(result_urls(spark, sf).withColumn("_one", F.lit(1).cast("long")), "query", ["page_id"],
                          "_one", "rank", op="sum", inclusive=True, width=IDS).drop("_one")
    return ranked.withColumn("rank", F.col("rank").cast("int")) \
        .withColumn("domain", U.two_label_domain(U.url_host(U.canonical_url(F.col("url")))))


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """Search results from pages: query = language path segment, title =
    <title> text, snippet = tag-stripped page, rank by page_id within the
    query, engine by page_id % 4. The texts join the ranks by page."""
    engines = F.array(*[F.lit(e[0]) for e in dims.ENGINES])
    texts = load(spark, sf, "pages").select(
        "page_id",
        X.clean_snippet(F.regexp_extract("html", TITLE_RE, 1)).alias("title"),
        X.clean_snippet(F.col("html")).alias("snippet"),
        F.element_at(engines, (F.col("page_id") % 4 + 1).cast("int")).alias("source_engine"))
    return ranked_urls(spark, sf).join(texts, "page_id")


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch log from pages: status by page_id % 10 (7: 404, 8: 500, 9: 301)."""
    p = load(spark, sf, "pages").select("page_id", "url", "html")
    m = F.col("page_id") % 10
    status = F.when(m == 7, 404).when(m == 8, 500).when(m == 9, 301).otherwise(200)
    return p.select("page_id", "url", status.cast("int").alias("status_code"),
                    F.col("html").alias("content"),
                    F.length("html").cast("long").alias("declared_length"))


ROBOTS_BASE = "# robots.txt\nUser-agent: *\nDisallow: /es/\nAllow: /es/5\n"
ROBOTS_EXTRA = "\nUser-agent: webspinbot\nDisallow: /de/\n"


def robots(spark: SparkSession, sf: str) -> DataFrame:
    """One robots.txt per two-label domain of the page URLs: agent '*'
    disallows /es/ but allows /es/5; odd-length domains add a block for our
    own agent."""
    p = load(spark, sf, "pages").select("url")
    d = p.select(U.two_label_domain(U.url_host(U.canonical_url(F.col("url")))).alias("domain")) \
        .distinct()
    text = F.concat(F.lit(ROBOTS_BASE),
                    F.when(F.length("domain") % 2 == 1, F.lit(ROBOTS_EXTRA)).otherwise(F.lit("")))
    return d.select("domain", text.alias("text"))
