"""U1-U8, D10 (raw link variant): URL jobs over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webspin.functions import urls as U


def canonicalize_urls(df: DataFrame, url_col: str = "url",
                      out_col: str = "normalized_url") -> DataFrame:
    """Add the canonical https URL."""
    return df.withColumn(out_col, U.canonical_url(F.col(url_col)))


def strip_tracking_params(df: DataFrame, query_col: str = "query",
                          out_col: str = "clean_query") -> DataFrame:
    """Filtered, re-encoded query string."""
    return df.withColumn(out_col, U.filter_query(F.col(query_col)))


def tracking_param_report(df: DataFrame, url_col: str = "url") -> DataFrame:
    """U2 report: per query key, how often it occurs and whether it is dropped."""
    q = U.split_url(F.regexp_replace(F.col(url_col), "[\\t\\r\\n]", ""))["query"]
    pairs = df.select(F.explode(F.split(q, "&")).alias("pair")) \
        .where(F.instr("pair", "=") > 0)
    key = U.form_decode(F.substring_index("pair", "=", 1))
    dropped = F.array_contains(U._lit_array(U.TRACKING_PARAMS), F.lower(key)) \
        | key.startswith("_")
    return (pairs.select(key.alias("param"), dropped.alias("dropped"))
            .groupBy("param", "dropped").agg(F.count(F.lit(1)).alias("n")))


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URL plus domain, subdomain, path, query map, hash."""
    norm = U.canonical_url(F.col(url_col))
    out = df.withColumn("normalized_url", norm)
    n = F.col("normalized_url")
    host = U.url_host(n)
    return out.select(
        "*",
        U.two_label_domain(host).alias("domain"),
        U.subdomain(host).alias("subdomain"),
        U.url_path(n).alias("path"),
        U.query_map(U.url_query(n)).alias("query_params"),
        n.startswith("https://").alias("is_secure"),
        U.url_hash(n).alias("url_hash"),
    )


def host_of(df: DataFrame, url_col: str = "url", out_col: str = "host") -> DataFrame:
    """U4: regex host of the raw URL."""
    return df.withColumn(out_col, U.host_of(F.col(url_col)))


def valid_urls(df: DataFrame, url_col: str = "url", strict: bool = False) -> DataFrame:
    """Keep rows whose URL has a scheme and a host (strict: http/https)."""
    return df.where(U.is_valid_url(F.col(url_col), strict))


def unwrap_redirects(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Replace '/l/?kh=..&uddg=<target>' redirect links by their target."""
    return df.withColumn(url_col, U.unwrap_redirect(F.col(url_col)))


def resolve_links(df: DataFrame, base_col: str, href_col: str,
                  out_col: str = "link", keep_http_only: bool = True) -> DataFrame:
    """Resolve hrefs against the base; keep http(s) links with a host."""
    out = df.withColumn(out_col, U.resolve_link(F.col(base_col), F.col(href_col)))
    if keep_http_only:
        out = out.where(U.is_valid_url(F.col(out_col), strict=True))
    return out


def dedupe_urls(df: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """U8: one row per canonical URL, the lowest id wins (deterministic).

    The window is partitioned by the whole canonical URL (url_hash is a short
    name for people: at a billion URLs some share one). Spark plans it as a
    WindowGroupLimit, which keeps one row per URL and task before the shuffle.
    """
    w = Window.partitionBy("normalized_url").orderBy(F.col(id_col).asc())
    return (df.withColumn("normalized_url", U.canonical_url(F.col(url_col)))
            .withColumn("url_hash", U.url_hash(F.col("normalized_url")))
            .withColumn("_rn", F.row_number().over(w))
            .where("_rn = 1").drop("_rn"))


# href values inside <a ...> tags: double, single or unquoted.
_A_HREF = "(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*[\"']?([^\"'\\s>]*)"


def _unescape_attr(c):
    for ent, ch in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The distinct resolved links of each page as one array column ``links``."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(_A_HREF), 1)
    bp = U.base_parts(F.col(url_col))
    keep = keep or []
    # base URL parts once per page; resolve, validate and de-duplicate inside
    # the page's href array (each href resolved once, no global distinct)
    staged = pages.select(F.col(id_col), F.col(url_col), *keep,
                          *[v.alias("_b_" + k) for k, v in bp.items() if k != "base"],
                          hrefs.alias("_hrefs"))
    parts = {"base": F.col(url_col), **{k: F.col("_b_" + k) for k in bp if k != "base"}}

    def one(h):
        h = _unescape_attr(h)
        return F.when(h.startswith("http://") | h.startswith("https://"), h) \
            .otherwise(U.resolve_link(F.col(url_col), h, parts))

    links = F.array_distinct(F.filter(F.transform("_hrefs", one),
                                      lambda l: U.is_valid_url(l, strict=False)))
    return staged.select(id_col, url_col, *keep, links.alias("links"))


def raw_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """D10 raw variant: every <a href> of the page (no pruning), resolved
    against the page URL, http(s) with a host only, distinct per page."""
    links = page_links(pages, id_col, url_col, html_col, keep)
    return links.select(id_col, url_col, *(keep or []), F.explode("links").alias("link"))
