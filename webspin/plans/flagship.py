"""Flagship: pages -> canonical URL, host, title, snippet text, quality score
-> best k pages per host. One Catalyst plan, no Python worker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webspin.functions import text as X
from webspin.functions import urls as U

TITLE_RE = "(?is)<title[^>]*>(.*?)</title>"


def page_records(pages: DataFrame) -> DataFrame:
    """A1 -> U1 -> U3 -> native D3 -> C2 -> E1 as one projection."""
    norm = U.canonical_url(F.col("url"))
    text = X.clean_snippet(F.col("html"))
    return (pages.select("page_id", "url", "html")
            .withColumn("normalized_url", norm)
            .withColumn("host", U.url_host(F.col("normalized_url")))
            .select(
                "page_id", "normalized_url", "host",
                U.two_label_domain(F.col("host")).alias("domain"),
                U.url_hash(F.col("normalized_url")).alias("url_hash"),
                X.clean_snippet(F.regexp_extract("html", TITLE_RE, 1)).alias("title"),
                F.round(X.quality_score(text), 6).alias("quality"),
                X.word_count(text).alias("words"),
            ))


def best_pages_per_host(pages: DataFrame, k: int = 10) -> DataFrame:
    """Top-k pages per host by quality (ties: lowest page_id).

    ``row_number() <= k`` is planned as a WindowGroupLimit: each map task
    keeps at most k rows per host before the shuffle, so a host holding a
    third of all pages ships only k rows per task.
    """
    w = Window.partitionBy("host").orderBy(F.col("quality").desc(), F.col("page_id").asc())
    return (page_records(pages)
            .withColumn("host_rank", F.row_number().over(w))
            .where(F.col("host_rank") <= k))
