"""Registered queries: DOM extraction (D0-D13), SERP html (A7), html to text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webspin.functions import text as X
from webspin.functions import urls as U
from webspin.operators import html as H
from webspin.sources.derived import search_results
from webspin.sources.tables import load

P_BLOCK_RE = "(?is)<p[^>]*>(.*?)</p>"


def _pages(spark, sf):
    return load(spark, sf, "pages").select("page_id", "url", "html")


def _rich(spark, sf):
    """Pages with author, date, keyword and description tags, a link and an
    image in the article, each on a part of the pages by page_id."""
    i = F.col("page_id")

    def n(c):
        return c.cast("string")
    meta = F.concat(
        F.when(i % 3 == 0, F.concat(F.lit('<meta name="author" content="Writer '), n(i % 7), F.lit('">'))).otherwise(F.lit("")),
        F.when(i % 4 == 0, F.concat(F.lit('<meta property="article:published_time" content="2024-03-0'), n(i % 9 + 1), F.lit('">')))
        .when(i % 4 == 1, F.concat(F.lit('<meta itemprop="datePublished" content="3/'), n(i % 27 + 1), F.lit('/2024">')))
        .when(i % 4 == 2, F.lit('<meta name="publishdate" content="soon">')).otherwise(F.lit("")),
        F.when(i % 2 == 0, F.concat(F.lit('<meta name="keywords" content="alpha, topic'), n(i % 5), F.lit(' ab">'))).otherwise(F.lit("")),
        F.when(i % 3 == 1, F.concat(F.lit('<meta name="description" content="A short account of page '), n(i), F.lit(' in one line.">'))).otherwise(F.lit("")))
    art = F.concat(F.lit('<article><a href="/p/'), n(i % 10), F.lit('">more here</a><img src="/i/'), n(i % 3), F.lit('.png" width="300" height="'), n(50 + i % 2 * 100), F.lit('">'))
    html = F.replace(F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), F.concat(F.lit('<meta charset="utf-8">'), meta)), F.lit("<article>"), art)
    return _pages(spark, sf).withColumn("html", html)


def q_d0(spark, sf):
    return H.page_fields(_pages(spark, sf), ["soup_elements", "html_length"]).drop("url")


def q_d1(spark, sf):
    e = H.extract_pages(_rich(spark, sf))
    return e.select("page_id", "title", F.length("main_content").alias("main_len"), "content_type",
                    "language", "word_count", "reading_time", "quality_score", "extraction_success",
                    F.size("links").alias("n_links"), F.size("extraction_errors").alias("n_errors"))


def q_d3(spark, sf):
    return H.page_fields(_pages(spark, sf), ["title"]).drop("url")


def q_d4(spark, sf):
    return H.page_fields(_pages(spark, sf), ["main_content"]).select(
        "page_id", F.md5("main_content").alias("main_md5"), F.length("main_content").alias("main_len"))


def q_d5_elements(spark, sf):
    return H.score_blocks(_pages(spark, sf))


def q_d5(spark, sf):
    p = _pages(spark, sf)
    blocks = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(P_BLOCK_RE), 1))
                      .alias("block_no", "raw"))
    t = X.clean_snippet(F.col("raw"))
    b = blocks.withColumn("text", t)
    n = F.length("text")
    sent = (F.size(F.split("text", "\\. ", -1)) - 1) + (F.size(F.split("text", "\\? ", -1)) - 1) \
        + (F.size(F.split("text", "! ", -1)) - 1)
    score = F.when(n > 100, F.least(n / 1000.0, F.lit(0.4))).otherwise(0.0) \
        + F.when(sent > 3, F.least(sent / 50.0, F.lit(0.2))).otherwise(0.0)
    w = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "block_no"))
    s = b.select("page_id", "block_no", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6)
                 .alias("score"))
    return s.withColumn("is_best", w == 1)


def q_d6(spark, sf):
    return H.page_fields(_rich(spark, sf), ["description"]).drop("url")


def q_d7(spark, sf):
    return H.page_fields(_rich(spark, sf), ["author"]).drop("url")


def q_d8(spark, sf):
    e = H.page_fields(_rich(spark, sf), ["publish_date"])
    parsed = F.coalesce(F.try_to_timestamp("publish_date", F.lit("yyyy-MM-dd")),
                        F.try_to_timestamp("publish_date", F.lit("M/d/yyyy")),
                        F.try_to_timestamp("publish_date", F.lit("MMMM d, yyyy")))
    return e.select("page_id", "publish_date", parsed.cast("timestamp_ntz").alias("published_at"))


def q_d9(spark, sf):
    e = H.page_fields(_rich(spark, sf), ["raw_keywords"])
    return e.select(F.explode(H.folded_words(F.col("raw_keywords"))).alias("keyword")).groupBy("keyword") \
        .agg(F.count(F.lit(1)).alias("n"))


def q_d10(spark, sf):
    return H.page_fields(_rich(spark, sf), ["links"]).select("page_id", F.explode("links").alias("link"))


def q_d11(spark, sf):
    return H.page_fields(_rich(spark, sf), ["images"]).select("page_id", F.size("images").alias("n_images"))


def q_d12(spark, sf):
    # every second page moves to a host that has rules of its own, or to a subdomain of one (which has not)
    hosts = [*H.DOMAIN_RULES, "en.wikipedia.org"]
    host = F.element_at(F.array(*[F.lit(h) for h in hosts]), (F.col("page_id") % len(hosts) + 1).cast("int"))
    p = _pages(spark, sf).select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www."), host, F.lit("/a"))).otherwise(F.col("url")).alias("url"))
    return H.rules_for(p).select("page_id", "host", "field", "pos", "selector", "around", F.array_join("attributes", ",").alias("attributes"), "min_len", "max_len")


def q_d13(spark, sf):
    m = H.main_block(_pages(spark, sf))
    return m.select("page_id", F.length("main_text").alias("main_len"))


def q_c3(spark, sf):
    t = H.html_to_text(_pages(spark, sf), preserve_links=True)
    return t.select("page_id", F.length("text").alias("text_len"), F.md5("text").alias("text_md5"))


def serp_html(spark, sf):
    """Result pages in the DuckDuckGo html shape, one result block per page
    of ``search_results``; links are redirect-wrapped."""
    r = search_results(spark, sf)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                                        F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit('<div class="result results_links"><h2><a href="/l/?kh=-1&amp;uddg='),
                    U.quote_plus(F.col("url")), F.lit('">'), esc(F.col("title")),
                    F.lit('</a></h2><span class="result__snippet">'), esc(F.col("snippet")),
                    F.lit("</span></div>"))
    return r.select("page_id", F.col("query"), html.alias("html"))


def q_a7(spark, sf):
    return H.parse_serp_html(serp_html(spark, sf), 10)


def q_a7_tool(spark, sf):
    return H.parse_serp_html(serp_html(spark, sf), 10, style="tool")


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def serp_html_bing(spark, sf):
    """Result pages in the Bing html shape, one li.b_algo per result."""
    r = search_results(spark, sf)
    html = F.concat(F.lit('<ol id="b_results"><li class="b_algo"><h2><a href="'), _esc(F.col("url")),
                    F.lit('">'), _esc(F.col("title")), F.lit("</a></h2><p>"), _esc(F.col("snippet")),
                    F.lit("</p></li></ol>"))
    return r.select("page_id", "query", html.alias("html"))


def q_a7_bing(spark, sf):
    return H.parse_serp_html(serp_html_bing(spark, sf), 10, style="bing")


QUERIES = {
    "D0_prune_dom": q_d0,
    "D1_extract_pages": q_d1,
    "D3_titles": q_d3,
    "D4_main_content": q_d4,
    "D5_score_blocks": q_d5,
    "D5_score_elements": q_d5_elements,
    "D6_descriptions": q_d6,
    "D7_authors": q_d7,
    "D8_publish_dates": q_d8,
    "D9_keyword_counts": q_d9,
    "D10_page_links": q_d10,
    "D11_page_images": q_d11,
    "D12_rules_for": q_d12,
    "D13_main_block": q_d13,
    "C3_html_to_text": q_c3,
    "A7_parse_serp_html": q_a7,
    "A7_parse_serp_html_tool": q_a7_tool,
    "A7_parse_serp_html_bing": q_a7_bing,
}
