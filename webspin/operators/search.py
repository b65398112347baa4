"""Search-result filtering, ranking, fallback, enrichment, stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspin import dims
from webspin.functions import text as X
from webspin.functions import urls as U
from webspin.operators.names import with_names

# Fixed value that must equal the reference (hard cap on results per query).
ABSOLUTE_MAX_RESULTS = 50
# The tool's own engine order (instant answer, html page, searx, bing);
# pass it as ``order`` to engine_fallback for that variant.
TOOL_FALLBACK_ORDER = ["instant_answer", "duckduckgo_html", "searx", "bing"]


def drop_blocked(df: DataFrame, blocked: DataFrame, domain_col: str = "host") -> DataFrame:
    """drop rows whose domain contains any blocked name."""
    return with_names(df, blocked, domain_col, keep=False)


def keep_preferred(df: DataFrame, preferred: DataFrame, domain_col: str = "host") -> DataFrame:
    """keep rows whose domain contains any preferred name."""
    return with_names(df, preferred, domain_col, keep=True)


def _contains_list(col: Column, names: list[str]) -> Column:
    c = F.lit(False)
    for n in names:
        c = c | (F.instr(col, n) > 0)
    return c


def domain_priority(df: DataFrame, blocked: list[str], preferred: list[str],
                    domain_col: str = "host") -> DataFrame:
    """0 blocked (tested first), 10 preferred, 5 otherwise."""
    d = F.coalesce(F.col(domain_col), F.lit(""))
    return df.withColumn("priority", F.when(_contains_list(d, blocked), 0)
                         .when(_contains_list(d, preferred), 10).otherwise(5))


def filter_domains(df: DataFrame, include: list[str] | None, exclude: list[str] | None,
                   blocked: DataFrame, domain_col: str = "host") -> DataFrame:
    """include list keeps, exclude list drops, the blocked list always drops."""
    spark = df.sparkSession
    out = drop_blocked(df, blocked, domain_col)
    if include:
        out = keep_preferred(out, spark.createDataFrame([(n,) for n in include], "name string"),
                             domain_col)
    if exclude:
        out = drop_blocked(out, spark.createDataFrame([(n,) for n in exclude], "name string"),
                           domain_col)
    return out


def relevance(df: DataFrame, query_col: str = "query") -> DataFrame:
    """0.5 * share of query words in the title + 0.3 * share in the
    snippet + 0.2 / rank (our formula; 0..1)."""
    qw = F.array_distinct(X.words(F.lower(F.col(query_col))))
    tw = X.words(F.lower(F.col("title")))
    sw = X.words(F.lower(F.col("snippet")))
    nq = F.greatest(F.size(qw), F.lit(1)).cast("double")
    score = (F.lit(0.5) * F.size(F.array_intersect(qw, tw)) / nq
             + F.lit(0.3) * F.size(F.array_intersect(qw, sw)) / nq
             + F.lit(0.2) / F.greatest(F.col("rank"), F.lit(1)))
    return df.withColumn("relevance", F.round(F.least(score, F.lit(1.0)), 6))


def top_results(df: DataFrame, k: int = 10, query_col: str = "query", hard_cap: int = ABSOLUTE_MAX_RESULTS) -> DataFrame:
    """first k per query in rank order; k beyond ``hard_cap`` is an error.
    Plans as a WindowGroupLimit, so each task ships at most k rows per query."""
    if k > hard_cap:
        raise ValueError(f"k = {k} is over the cap of {hard_cap} results per query")
    w = Window.partitionBy(query_col).orderBy(F.col("rank"), F.col("url"))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def engine_fallback(responses: DataFrame, target: Column | str,
                    order: list[str] | None = None) -> DataFrame:
    """per query pick the target engine if it succeeded with results,
    else the first usable engine of ``order`` (skipping the target), else the
    target's failure row. ``responses`` has (query, engine, success,
    n_results). Output adds used_fallback and original_engine.

    One window ranking per query; the priority table is bounded.
    """
    order = order or dims.FALLBACK_ENGINES
    tgt = F.lit(target) if isinstance(target, str) else target
    pos = F.array_position(F.array(*[F.lit(e) for e in order]), F.col("engine"))
    usable = F.col("success") & (F.col("n_results") > 0)
    is_target = F.col("engine") == F.col("original_engine")
    r = responses.withColumn("original_engine", tgt)
    prio = (F.when(usable & is_target, 0)
            .when(usable & (pos > 0) & ~is_target, pos)
            .when(is_target, 1000).otherwise(None))
    r = r.withColumn("_prio", prio).where(F.col("_prio").isNotNull())
    w = Window.partitionBy("query").orderBy("_prio")
    best = r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.select("query", "engine", "success", "n_results", "original_engine",
                       (F.col("engine") != F.col("original_engine")).alias("used_fallback"))


def tool_chain(responses: DataFrame, order: list[str] | None = None) -> DataFrame:
    """F7, the tool's form: per query the first engine of the chain that
    answered with results; used_fallback if it isn't the chain's first. Queries
    that no engine answers have no row. One ranking of a few rows per query."""
    order = order or TOOL_FALLBACK_ORDER
    pos = F.array_position(F.array(*[F.lit(e) for e in order]), F.col("engine"))
    r = responses.withColumn("_pos", pos).where(F.col("success") & (F.col("n_results") > 0) & (pos > 0))
    best = r.groupBy("query").agg(F.min_by(F.struct("engine", "n_results", "_pos"), "_pos").alias("b"))
    return best.select("query", "b.engine", "b.n_results", (F.col("b._pos") > 1).alias("used_fallback"))


def first_mirror(responses: DataFrame, mirrors: int = 3) -> DataFrame:
    """F7, mirrors of one engine: (query, mirror, n_results) of the first of
    ``mirrors`` mirrors (0, 1, ...) with any result; null where none has."""
    some = F.when((F.col("n_results") > 0) & (F.col("mirror") < mirrors), F.col("mirror"))
    g = responses.groupBy("query").agg(F.min(some).alias("mirror"), F.min_by("n_results", some).alias("n_results"))
    return g.select("query", "mirror", F.when(F.col("mirror").isNull(), 0).otherwise(F.col("n_results")).alias("n_results"))


def response_summary_parsed(parsed: DataFrame) -> DataFrame:
    """Per (query, engine) from one parsing pass (``parse_any_payloads``):
    did the engine answer (any parsable payload) and how many results it
    gave. Partial aggregation before the shuffle."""
    return parsed.groupBy("query", "engine").agg(
        F.bool_or("ok").alias("success"),
        F.count_if("valid").alias("n_results"))


def enrich_results(results: DataFrame, pages: DataFrame, allowed: DataFrame,
                   extract: bool = True) -> DataFrame:
    """left join results to extracted page content on the canonical URL;
    robots-blocked rows keep the result but get null content and count as a
    block; without extraction content is null."""
    r = results.withColumn("normalized_url", U.canonical_url(F.col("url")))
    # one page per canonical URL (U8: the lowest id), so that results never multiply
    p = pages.select(F.col("normalized_url"), F.col("content"), F.col("page_id").alias("_pid"))
    p = p.withColumn("_rn", F.row_number().over(Window.partitionBy("normalized_url").orderBy("_pid"))).where("_rn = 1").drop("_rn")
    a = allowed.select(F.col("page_id").alias("_pid"), F.col("allowed"))
    pa = p.join(a, "_pid", "left").drop("_pid")
    j = r.join(pa, "normalized_url", "left")
    blocked = F.coalesce(~F.col("allowed"), F.lit(False))
    content = F.when(F.lit(extract) & ~blocked, F.col("content"))
    return j.withColumn("content", content).withColumn("robots_blocked", blocked).drop("allowed")


def infer_content_type(df: DataFrame, query_type: Column | str = "general",
                       url_col: str = "url") -> DataFrame:
    """documentation / forum_post / article by URL, with academic and
    technical overrides for those query types."""
    qt = F.lit(query_type) if isinstance(query_type, str) else query_type
    u = F.lower(F.coalesce(F.col(url_col), F.lit("")))
    general = (F.when((F.instr(u, "docs.") > 0) | (F.instr(u, "github") > 0), "documentation")
               .when((F.instr(u, "stackoverflow") > 0) | (F.instr(u, "reddit") > 0), "forum_post")
               .otherwise("article"))
    t = (F.when((qt == "academic") & (F.instr(u, "arxiv") > 0), "academic")
         .when((qt == "technical") & (F.instr(u, "docs") > 0), "technical")
         .otherwise(general))
    return df.withColumn("content_type", t)


def expand_queries(df: DataFrame, query_col: str = "query", type_col: str = "query_type") -> DataFrame:
    """append the type's modifiers, set its max_results, list preferred
    engines and domains; unknown types use 'general'. Broadcast join to the
    four-row query-type table."""
    qt = F.broadcast(dims.query_types(df.sparkSession).withColumnRenamed("query_type", "_qt"))
    known = [r[0] for r in dims.QUERY_TYPES]
    x = df.withColumn("_t", F.when(F.col(type_col).isin(known), F.col(type_col)).otherwise("general"))
    j = x.join(qt, x["_t"] == qt["_qt"], "left")
    expanded = F.when(F.size("modifiers") > 0,
                      F.concat_ws(" ", F.col(query_col), F.array_join("modifiers", " "))) \
        .otherwise(F.col(query_col))
    return j.withColumn("expanded_query", expanded).withColumnRenamed("_t", "effective_type") \
        .drop("_qt", "modifiers")


def valid_results(df: DataFrame) -> DataFrame:
    """title and http(s) URL present; numeric-only and 'click here'
    titles dropped."""
    t = F.trim(F.coalesce(F.col("title"), F.lit("")))
    return df.where((t != "") & U.is_valid_url(F.col("url"), strict=True)
                    & ~t.rlike("^[0-9]+$") & ~F.lower(t).startswith("click here"))


def normalize_results(df: DataFrame) -> DataFrame:
    """every result gets the canonical URL and the two-label domain."""
    n = U.canonical_url(F.col("url"))
    return df.withColumn("url", n).withColumn("domain", U.two_label_domain(U.url_host(n)))


def engine_health(log: DataFrame) -> DataFrame:
    """per engine: searches, errors, healthy (last search ok), mean
    search time, plus configuration (enabled, requires_api_key)."""
    g = log.groupBy("engine").agg(
        F.count(F.lit(1)).alias("searches"),
        F.count_if(~F.col("success")).alias("errors"),
        F.max_by("success", F.struct("ts", "event_id")).alias("healthy"),
        # exact (order-independent) mean from integer micro-units
        (F.sum(F.round(F.col("search_time") * 1_000_000).cast("long")) / F.count("search_time")
         / F.lit(1_000_000.0)).alias("avg_search_time"))
    cfg = F.broadcast(dims.engines(log.sparkSession).select("engine", "enabled", "requires_api_key"))
    return g.join(cfg, "engine", "left")


def available_engines(log: DataFrame, keys_present: list[str] | None = None) -> DataFrame:
    """engines of the log that are enabled and need no key (or have one)."""
    keys = keys_present or []
    cfg = dims.engines(log.sparkSession).where(
        F.col("enabled") & (~F.col("requires_api_key") | F.col("engine").isin(keys)))
    used = log.select("engine").distinct()
    return used.join(F.broadcast(cfg.select("engine")), "engine", "left_semi")


def tool_stats(log: DataFrame, cache_replay: DataFrame | None = None,
               limiter_replay: DataFrame | None = None, page_decisions: DataFrame | None = None) -> DataFrame:
    """F16: per day: total, successful, engine failures, and (when the
    replays are given) cache hits (H2), rate-limit blocks (I4) and fetches
    that robots rules forbid (G3's decisions with the time of the fetch).

    Every input is first reduced to one row per day (partial aggregation),
    so the joins are between day-sized tables."""
    def day(c):
        return F.window(F.col(c).cast("timestamp"), "1 day")["start"].cast("timestamp_ntz")

    out = log.groupBy(day("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("engine_failures"))
    if cache_replay is not None:
        hits = cache_replay.groupBy(day("ts").alias("day")).agg(F.count_if("hit").alias("cache_hits"))
        out = out.join(hits, "day", "left").fillna(0, ["cache_hits"])
    if limiter_replay is not None:
        blocks = limiter_replay.groupBy(day("ts").alias("day")).agg(
            F.count_if(~F.col("allowed")).alias("rate_limit_blocks"))
        out = out.join(blocks, "day", "left").fillna(0, ["rate_limit_blocks"])
    if page_decisions is not None:
        kept_out = page_decisions.groupBy(day("ts").alias("day")).agg(F.count_if(~F.col("allowed")).alias("robots_blocks"))
        out = out.join(kept_out, "day", "left").fillna(0, ["robots_blocks"])
    return out


def format_results(results: DataFrame, query_col: str = "query", engine_col: str = "engine") -> DataFrame:
    """One text per query: header, then per result (numbered in rank
    order) a bold title line, URL, Description and a blank line.

    Grouping collects one query's result lines; results per query are capped
    upstream (F6, at most 50), so the collected list is bounded.
    """
    line = F.struct(F.col("rank").alias("r"), F.col("url").alias("u"),
                    F.col("title").alias("t"), F.col("snippet").alias("s"))
    g = results.groupBy(query_col, engine_col).agg(F.array_sort(F.collect_list(line)).alias("_rs"))
    numbered = F.transform("_rs", lambda x, i: F.concat(
        F.lit("**"), (i + 1).cast("string"), F.lit(". "), F.coalesce(x["t"], F.lit("No title")),
        F.lit("**\nURL: "), F.coalesce(x["u"], F.lit("No URL")),
        F.lit("\nDescription: "), F.coalesce(x["s"], F.lit("No description")), F.lit("\n")))
    header = F.concat(F.lit("Found "), F.size("_rs").cast("string"), F.lit(" results for '"),
                      F.col(query_col), F.lit("' (via "), F.col(engine_col), F.lit("):\n"))
    text = F.when(F.size("_rs") == 0, F.concat(F.lit("No results found for '"), F.col(query_col),
                                               F.lit("'"))) \
        .otherwise(F.concat(header, F.lit("\n"), F.array_join(numbered, "\n")))
    return g.select(query_col, engine_col, F.size("_rs").alias("n_results"), text.alias("formatted"))
