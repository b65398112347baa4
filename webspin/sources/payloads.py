"""Search-engine payload parsers and request parsing (native
``from_json`` + ``posexplode``; malformed JSON yields null, hence no rows).

Also builds the derived ``serp`` payload table from ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webspin.functions import text as X
from webspin.functions import urls as U
from webspin.sources.tables import load

GOOGLE_SCHEMA = ("struct<items:array<struct<title:string,link:string,snippet:string,"
                 "cacheId:string,kind:string>>>")
SEARX_SCHEMA = ("struct<results:array<struct<url:string,title:string,content:string,"
                "engines:array<string>,score:double>>>")
BING_SCHEMA = ("struct<webPages:struct<value:array<struct<name:string,url:string,snippet:string,"
               "dateLastCrawled:string,displayUrl:string>>>>")
INSTANT_SCHEMA = ("struct<Heading:string,AbstractURL:string,Abstract:string,"
                  "RelatedTopics:array<struct<Text:string,FirstURL:string>>>")

RESULT_COLS = ["query", "engine", "rank", "title", "url", "snippet"]


def _valid(title: Column, url: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "") \
        & U.is_valid_url(url, strict=True)


RAW_TYPE = "array<struct<title:string,url:string,snippet:string>>"


def _raw(items: Column, title, url, snippet) -> Column:
    return F.transform(items, lambda it: F.struct(title(it).alias("title"), url(it).alias("url"),
                                                  snippet(it).alias("snippet")))


def any_engine_items(engine: Column, payload: Column, max_results: int = 10) -> Column:
    """Raw items of whichever engine shape the row carries (null when the
    payload has none): one pass over a mixed payload table instead of one
    scan per engine. Only field projections run inside the lambdas."""
    g = F.from_json(payload, GOOGLE_SCHEMA)["items"]
    x = F.slice(F.from_json(payload, SEARX_SCHEMA)["results"], 1, max_results)
    b = F.from_json(payload, BING_SCHEMA)["webPages"]["value"]
    return (F.when(engine == "google_custom",
                   _raw(g, lambda it: it["title"], lambda it: it["link"], lambda it: it["snippet"]))
            .when(engine == "searx",
                  _raw(x, lambda it: it["title"], lambda it: it["url"], lambda it: it["content"]))
            .when(engine == "bing",
                  _raw(b, lambda it: it["name"], lambda it: it["url"], lambda it: it["snippet"])))


def parse_any_payloads(df: DataFrame, max_results: int = 10, payload: str = "payload") -> DataFrame:
    """One row per raw item (and one per payload without items, so the
    answer flag survives): ok = the payload parsed at all; rank = raw
    position + 1; title/snippet cleaned; valid = title and http(s) URL."""
    ok = F.col(payload).isNotNull() & F.get_json_object(F.col(payload), "$").isNotNull()
    x = df.select("query", "engine", ok.alias("ok"),
                  F.posexplode_outer(any_engine_items(F.col("engine"), F.col(payload), max_results))
                  .alias("_pos", "_it"))
    title = X.clean_snippet(F.col("_it.title"))
    out = x.select("query", "engine", "ok", (F.col("_pos") + 1).cast("int").alias("rank"),
                   title.alias("title"), F.col("_it.url").alias("url"),
                   X.clean_snippet(F.col("_it.snippet")).alias("snippet"))
    return out.withColumn("valid", F.col("rank").isNotNull() & _valid(F.col("title"), F.col("url")))


def _explode(df: DataFrame, arr: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(arr).alias("_pos", "_it"))


def parse_google_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A3: ``items[]``; rank = raw position + 1 (gaps stay after drops)."""
    p = df.withColumn("_j", F.from_json(F.col(payload), GOOGLE_SCHEMA))
    x = _explode(p, F.col("_j.items"), ["query", "engine"])
    it = F.col("_it")
    out = x.select("query", "engine", (F.col("_pos") + 1).alias("rank"),
                   X.clean_snippet(it["title"]).alias("title"), it["link"].alias("url"),
                   X.clean_snippet(it["snippet"]).alias("snippet"),
                   it["cacheId"].alias("cache_id"), it["kind"].alias("kind"))
    return out.where(_valid(F.col("title"), F.col("url")))


def parse_searx_payloads(df: DataFrame, max_results: int = 10, payload: str = "payload") -> DataFrame:
    """A4: ``results[]`` sliced to ``max_results`` before validation."""
    p = df.withColumn("_j", F.from_json(F.col(payload), SEARX_SCHEMA))
    x = _explode(p, F.slice(F.col("_j.results"), 1, max_results), ["query", "engine"])
    it = F.col("_it")
    out = x.select("query", "engine", (F.col("_pos") + 1).alias("rank"),
                   X.clean_snippet(it["title"]).alias("title"), it["url"].alias("url"),
                   X.clean_snippet(it["content"]).alias("snippet"),
                   F.array_join(it["engines"], ",").alias("engines"), it["score"].alias("score"))
    return out.where(_valid(F.col("title"), F.col("url")))


def parse_bing_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A5: ``webPages.value[]``; ``name`` becomes the title."""
    p = df.withColumn("_j", F.from_json(F.col(payload), BING_SCHEMA))
    x = _explode(p, F.col("_j.webPages.value"), ["query", "engine"])
    it = F.col("_it")
    out = x.select("query", "engine", (F.col("_pos") + 1).alias("rank"),
                   X.clean_snippet(it["name"]).alias("title"), it["url"].alias("url"),
                   X.clean_snippet(it["snippet"]).alias("snippet"),
                   it["dateLastCrawled"].alias("date_last_crawled"),
                   it["displayUrl"].alias("display_url"))
    return out.where(_valid(F.col("title"), F.col("url")))


def parse_instant_answers(df: DataFrame, max_results: int = 10, payload: str = "payload") -> DataFrame:
    """Abstract row first (if non-empty; title = Heading, or the query
    when the key is missing), then the first ``max_results - 1`` related
    topics that have text (title = text before ' - '); cut to max_results."""
    p = df.withColumn("_j", F.from_json(F.col(payload), INSTANT_SCHEMA)).where(F.col("_j").isNotNull())
    j = F.col("_j")
    abstract = F.when(F.coalesce(j["Abstract"], F.lit("")) != "", F.array(F.struct(
        F.coalesce(j["Heading"], F.col("query")).alias("title"),
        F.coalesce(j["AbstractURL"], F.lit("")).alias("url"),
        F.substring(j["Abstract"], 1, 300).alias("snippet")))).otherwise(
        F.array().cast("array<struct<title:string,url:string,snippet:string>>"))
    topics = F.filter(F.slice(F.coalesce(j["RelatedTopics"], F.array()), 1, max(max_results - 1, 0)),
                      lambda t: F.coalesce(t["Text"], F.lit("")) != "")
    topic_rows = F.transform(topics, lambda t: F.struct(
        F.substring_index(t["Text"], " - ", 1).alias("title"),
        F.coalesce(t["FirstURL"], F.lit("")).alias("url"),
        F.substring(t["Text"], 1, 300).alias("snippet")))
    rows = F.slice(F.concat(abstract, topic_rows), 1, max_results)
    x = p.select("query", "engine", F.posexplode(rows).alias("_pos", "_it"))
    return x.select("query", "engine", (F.col("_pos") + 1).alias("rank"),
                    F.col("_it.title").alias("title"), F.col("_it.url").alias("url"),
                    F.col("_it.snippet").alias("snippet"))


REQUEST_SCHEMA = "struct<query:string,max_results:int,query_type:string,extract_content:boolean>"


def parse_requests(df: DataFrame, raw: str = "raw", overrides: str | None = None) -> DataFrame:
    """Raw request text is a JSON object or a plain query. Defaults:
    max_results 10, query_type 'general', extract_content true; an explicit
    override (map column) wins; malformed JSON means the whole text is the
    query."""
    r = F.col(raw)
    # one JSON object and nothing after it: inside brackets, trailing text is an error
    boxed = F.concat(F.lit("["), r, F.lit("]"))
    is_obj = F.trim(r).startswith("{") & F.expr(f"try_parse_json(concat('[', {raw}, ']'))").isNotNull() & (F.json_array_length(boxed) == 1)
    j = F.when(is_obj, F.from_json(r, REQUEST_SCHEMA))
    ov = (lambda k: F.col(overrides)[k]) if overrides else (lambda k: F.lit(None).cast("string"))
    return df.select(
        "*",
        F.coalesce(ov("query"), j["query"], r).alias("query"),
        F.coalesce(ov("max_results").cast("int"), j["max_results"], F.lit(10)).alias("max_results"),
        F.coalesce(ov("query_type"), j["query_type"], F.lit("general")).alias("query_type"),
        F.coalesce(ov("extract_content").cast("boolean"), j["extract_content"], F.lit(True))
        .alias("extract_content"))


def serp(spark: SparkSession, sf: str) -> DataFrame:
    """Derived payloads: per document one item in each engine's JSON shape.

    query = source:lang; google items exist for English documents only (the
    others answer without ``items``), every 50th document's google payload is
    malformed JSON; the instant answer has an Abstract for every third
    document and two related topics (one without text)."""
    d = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    first = F.trim(F.split(F.col("text"), "\n").getItem(0))
    title = first
    link = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"),
                    F.lit("/"), F.col("doc_id").cast("string"))
    snippet = F.col("text")
    q = F.concat_ws(":", F.col("source"), F.col("lang"))
    google = F.when(F.col("doc_id") % 50 == 0, F.lit("not json {")).when(
        F.col("lang") == "en",
        F.to_json(F.struct(F.array(F.struct(title.alias("title"), link.alias("link"),
                                            snippet.alias("snippet"),
                                            F.col("doc_id").cast("string").alias("cacheId"),
                                            F.lit("customsearch#result").alias("kind"))).alias("items")))
    ).otherwise(F.to_json(F.struct(F.lit("customsearch#search").alias("kind"))))
    searx = F.to_json(F.struct(F.array(F.struct(
        link.alias("url"), title.alias("title"), snippet.alias("content"),
        F.array(F.lit("google"), F.lit("bing")).alias("engines"),
        (F.col("doc_id") % 7 / 7.0).alias("score"))).alias("results")))
    bing = F.to_json(F.struct(F.struct(F.array(F.struct(
        title.alias("name"), link.alias("url"), snippet.alias("snippet"),
        F.lit("2024-01-01T00:00:00").alias("dateLastCrawled"), link.alias("displayUrl")))
        .alias("value")).alias("webPages")))
    instant = F.to_json(F.struct(
        title.alias("Heading"), link.alias("AbstractURL"),
        F.when(F.col("doc_id") % 3 == 0, F.col("text"))
        .otherwise(F.lit("")).alias("Abstract"),
        F.array(F.struct(F.concat(title, F.lit(" - "), F.col("source")).alias("Text"),
                         link.alias("FirstURL")),
                F.struct(F.lit("").alias("Text"), link.alias("FirstURL"))).alias("RelatedTopics")))
    rows = F.array(
        F.struct(F.lit("google_custom").alias("engine"), google.alias("payload")),
        F.struct(F.lit("searx").alias("engine"), searx.alias("payload")),
        F.struct(F.lit("bing").alias("engine"), bing.alias("payload")),
        F.struct(F.lit("instant_answer").alias("engine"), instant.alias("payload")))
    return d.select("doc_id", q.alias("query"), F.inline(rows))
