"""Registered queries: flagship, URL jobs (U1-U8), links (D10 raw, X10, X11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspin.functions import urls as U
from webspin.operators import urls as UO
from webspin.plans import corpus, flagship
from webspin.sources.tables import load


def q_flagship(spark: SparkSession, sf: str) -> DataFrame:
    return flagship.best_pages_per_host(load(spark, sf, "pages"), k=10)


def q_u1(spark: SparkSession, sf: str) -> DataFrame:
    return UO.canonicalize_urls(load(spark, sf, "pages").select("page_id", "url"))


def q_u2(spark: SparkSession, sf: str) -> DataFrame:
    return UO.tracking_param_report(load(spark, sf, "pages").select("url"))


def q_u2_clean(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", "url")
    q = U.split_url(F.col("url"))["query"]
    return pages.select("page_id", q.alias("query"),
                        U.filter_query(q).alias("clean_query"))


def q_u3(spark: SparkSession, sf: str) -> DataFrame:
    parts = UO.url_parts(load(spark, sf, "pages").select("page_id", "url"))
    return parts.select("page_id", "normalized_url", "domain", "subdomain", "path",
                        F.size("query_params").alias("n_params"), "is_secure", "url_hash")


def q_u4(spark: SparkSession, sf: str) -> DataFrame:
    return UO.host_of(load(spark, sf, "pages").select("page_id", "url"))


def _hrefs(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url",
                        F.explode(F.regexp_extract_all("html", F.lit(UO._A_HREF), 1))
                        .alias("href"))


def q_u5(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", F.col("url").alias("candidate"))
    hrefs = _hrefs(spark, sf).select("page_id", F.col("href").alias("candidate"))
    cand = pages.unionByName(hrefs)
    return (cand.groupBy("page_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(U.is_valid_url(F.col("candidate"))).alias("n_loose"),
                 F.count_if(U.is_valid_url(F.col("candidate"), strict=True)).alias("n_strict")))


def q_u6(spark: SparkSession, sf: str) -> DataFrame:
    # redirect-wrapped form of every page URL, derived from the page table
    pages = load(spark, sf, "pages").select("page_id", "url")
    wrapped = F.concat(F.lit("/l/?kh=-1&uddg="), U.quote_plus(F.col("url")))
    out = UO.unwrap_redirects(pages.select("page_id", wrapped.alias("wrapped"),
                                           wrapped.alias("url")))
    return out.select("page_id", "wrapped", F.col("url").alias("unwrapped"))


def q_u6_clean(spark: SparkSession, sf: str) -> DataFrame:
    # three link shapes per page URL: protocol-relative, absolute redirect, relative path
    pages = load(spark, sf, "pages").select("page_id", "url")
    rel = F.regexp_replace("url", "^https?:", "")
    redirect = F.concat(F.lit("https://duckduckgo.com/l/?uddg="), U.quote_plus(F.col("url")),
                        F.lit("&rut=x"))
    path = U.url_path(U.canonical_url(F.col("url")))
    forms = F.array(F.struct(F.lit("protocol_relative").alias("form"), rel.alias("raw")),
                    F.struct(F.lit("redirect").alias("form"), redirect.alias("raw")),
                    F.struct(F.lit("relative").alias("form"), path.alias("raw")))
    x = pages.select("page_id", F.inline(forms))
    return x.select("page_id", "form", "raw", U.clean_result_url(F.col("raw")).alias("cleaned"))


def q_a1(spark: SparkSession, sf: str) -> DataFrame:
    names = ["pages", "documents", "labels", "benchmark", "conversations", "events"]
    parts = [load(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
             for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_u7(spark: SparkSession, sf: str) -> DataFrame:
    return UO.resolve_links(_hrefs(spark, sf), "url", "href").select("page_id", "href", "link")


def q_u8(spark: SparkSession, sf: str) -> DataFrame:
    return UO.dedupe_urls(load(spark, sf, "pages").select("page_id", "url")) \
        .select("page_id", "normalized_url", "url_hash")


def q_d10_raw(spark: SparkSession, sf: str) -> DataFrame:
    return UO.raw_links(load(spark, sf, "pages").select("page_id", "url", "html")) \
        .select("page_id", "link")


def q_x10(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.crawl_frontier(load(spark, sf, "pages").select("page_id", "url", "html"))


def q_x11(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.link_graph(load(spark, sf, "pages").select("page_id", "url", "html"))


def q_x11_in_degree(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.host_in_degree(load(spark, sf, "pages").select("page_id", "url", "html"))


QUERIES = {
    "flagship_best_pages": q_flagship,
    "U1_canonicalize_urls": q_u1,
    "U2_tracking_param_report": q_u2,
    "U2_strip_tracking_params": q_u2_clean,
    "U3_url_parts": q_u3,
    "U4_host_of": q_u4,
    "U5_valid_urls": q_u5,
    "U6_unwrap_redirects": q_u6,
    "U6_clean_result_urls": q_u6_clean,
    "A1_load_tables": q_a1,
    "U7_resolve_links": q_u7,
    "U8_dedupe_urls": q_u8,
    "D10_raw_page_links": q_d10_raw,
    "X10_crawl_frontier": q_x10,
    "X11_link_graph": q_x11,
    "X11_host_in_degree": q_x11_in_degree,
}
