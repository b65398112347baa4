"""Corpus jobs composed from the URL, link and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webspin.functions import text as X
from webspin.functions import urls as U
from webspin.operators.urls import page_links


def _counted_targets(pages: DataFrame, name: str, target) -> DataFrame:
    """(src_url, name, n): per page, its distinct link targets and how many of
    its distinct raw links go there. Links and targets are each computed once, behind
    a generator; a page's targets are counted by sorting them and looking at
    the borders of equal runs, so a page of any size stays one linear pass."""
    src = pages.withColumn("src_url", U.canonical_url(F.col("url")))
    links = page_links(src, keep=["src_url"])
    # an explode of one value keeps the optimizer from copying the expression into each use
    sorted_ = links.select("src_url", F.explode(F.array(F.array_sort(F.transform("links", lambda l: F.coalesce(target(l), F.lit("")))))).alias("_t"))
    ends = sorted_.select("src_url", "_t", F.expr("filter(sequence(1, size(_t)), i -> i = size(_t) or _t[i] != _t[i - 1])").alias("_e")).where("size(_t) > 0")
    runs = F.expr(f"transform(_e, (e, k) -> named_struct('{name}', _t[e - 1], 'n', cast(e - if(k = 0, 0, _e[k - 1]) as bigint)))")
    return ends.select("src_url", F.inline(runs))


def crawl_frontier(pages: DataFrame) -> DataFrame:
    """Canonical link targets that are not fetched pages yet, with the
    links and the pages that point there (``pages`` has a row per page).

    Targets are counted within each page and then summed with map-side partial
    aggregation; the anti join sees one row per target, not one per edge.
    """
    targets = _counted_targets(pages, "dst_url", U.canonical_url).groupBy("dst_url").agg(
        F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_pages"))
    fetched = pages.select(U.canonical_url(F.col("url")).alias("dst_url"))
    return targets.join(fetched, "dst_url", "left_anti")


def link_graph(pages: DataFrame) -> DataFrame:
    """X11: host-level edges with counts, summed like the frontier."""
    hosts = _counted_targets(pages, "dst_host", lambda l: U.url_host(U.canonical_url(l)))
    return hosts.groupBy(U.url_host(F.col("src_url")).alias("src_host"), "dst_host").agg(
        F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_pages"))


def host_in_degree(pages: DataFrame) -> DataFrame:
    """X11 summary: distinct linking hosts and pages per target host."""
    g = link_graph(pages)
    return (g.groupBy("dst_host")
            .agg(F.count("src_host").alias("in_hosts"),  # the graph has one row per pair of hosts
                 F.sum("n_links").alias("in_links")))


def curate_corpus(docs: DataFrame, min_quality: float = 0.5,
                  min_len: int = 100, max_len: int = 50000) -> DataFrame:
    """Valid (E2), inside length bounds (E4), quality >= t (E1), one row
    per exact copy (C5: lowest doc_id per content hash).

    The de-duplication window partitions by content hash; a hash held by a
    third of all rows is still one sort inside one task, and the
    ``row_number() = 1`` filter is planned as a WindowGroupLimit so each map
    task forwards at most one row per hash.
    """
    t = F.col("text")
    cleaned = X.clean_text(t)
    # cheap bounds as a filter (pushed into the scan); the text predicates
    # as generators, evaluated once and after the input is spread
    bounded = docs.select("doc_id", "text", "source") \
        .where((F.length(t) >= min_len) & (F.length(t) <= max_len))
    bounded = X.keep_where(bounded, "_valid", X.is_valid_content(t), lambda v: v).drop("_valid")
    scored = X.keep_where(bounded, "quality", F.round(X.quality_score(t), 6),
                          lambda q: q >= min_quality) \
        .select("doc_id", "source", "quality", F.length(t).alias("n_chars"),
                F.md5(cleaned).alias("content_hash"))  # the text never crosses the shuffle
    w = Window.partitionBy("content_hash").orderBy("doc_id")
    return (scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("doc_id", "source", "quality", "n_chars"))
