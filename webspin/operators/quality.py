"""E1-E5 and D2 (native part): quality scores, validity, page types, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspin import dims
from webspin.functions import text as X

# Fixed values that must equal the reference (URL substrings per page type, D2).
URL_TYPE_PATTERNS = [
    ("documentation", ["docs", "documentation", "api", "guide"]),
    ("forum_post", ["forum", "discuss", "community"]),
    ("academic", ["paper", "journal", "research", "scholar"]),
]


def quality_scores(df: DataFrame, col: str = "text", out: str = "quality") -> DataFrame:
    """Quality score in [0, 1] (rounded to 6 decimals for stable output)."""
    return df.withColumn(out, F.round(X.quality_score(F.col(col)), 6))


def valid_content(df: DataFrame, col: str = "text", out: str = "valid") -> DataFrame:
    """Long enough and free of the invalid-content patterns."""
    return df.withColumn(out, X.is_valid_content(F.col(col)))


def url_page_type(url: Column) -> Column:
    """D2, URL part: the first matching substring family wins, else null."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = None
    for ptype, subs in URL_TYPE_PATTERNS:
        cond = F.lit(False)
        for s in subs:
            cond = cond | (F.instr(low, s) > 0)
        out = F.when(cond, F.lit(ptype)) if out is None else out.when(cond, F.lit(ptype))
    return out


# DOM flags as regexes over the raw html (fast path of D2's DOM part).
ARTICLE_TAG_RE = "(?i)<article[\\s>/]|role\\s*=\\s*[\"']?article[\"'\\s>]"
ARTICLE_CLASS_RE = "(?i)class\\s*=\\s*[\"'][^\"']*(post|article|entry)"
DOC_CLASS_RE = "(?i)class\\s*=\\s*[\"'][^\"']*(doc|documentation)"


def page_types(df: DataFrame, url_col: str = "url", html_col: str = "html",
               out: str = "page_type") -> DataFrame:
    """URL substrings first, then DOM flags, default 'article'."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    dom = (F.when(h.rlike(ARTICLE_TAG_RE), "article")
           .when(h.rlike(ARTICLE_CLASS_RE), "article")
           .when(h.rlike(DOC_CLASS_RE), "documentation")
           .otherwise("article"))
    return df.withColumn(out, F.coalesce(url_page_type(F.col(url_col)), dom))


def validate_extraction(df: DataFrame, title_col: str = "title", body_col: str = "main_content",
                        type_col: str = "page_type", quality_col: str | None = None,
                        out: str = "extraction_success") -> DataFrame:
    """Per page type, title present, body long enough, quality above the
    type's threshold; unknown types use the article rule.

    The rule table has four rows (fixed by construction): broadcast join.
    """
    rules = F.broadcast(dims.page_type_rules(df.sparkSession)
                        .withColumnRenamed("page_type", "_rule_type"))
    t = F.coalesce(F.col(type_col), F.lit("article"))
    keyed = df.withColumn("_ptype", F.when(t.isin([r[0] for r in dims.PAGE_TYPE_RULES]), t)
                          .otherwise(F.lit("article")))
    body = F.coalesce(F.col(body_col), F.lit(""))
    q = F.col(quality_col) if quality_col else X.quality_score(body)
    joined = keyed.join(rules, keyed["_ptype"] == rules["_rule_type"], "left")
    ok = ((F.coalesce(F.col(title_col), F.lit("")) != "")
          & (body != "") & (F.length(body) >= F.col("min_content_length"))
          & ((body == "") | (q >= F.col("quality_threshold"))))
    return joined.withColumn(out, ok).drop("_ptype", "_rule_type", "min_content_length",
                                           "quality_threshold")


def length_window(df: DataFrame, col: str = "text", min_len: int = 100,
                  max_len: int = 50000) -> DataFrame:
    """Content length bounds."""
    n = F.length(F.col(col))
    return df.where((n >= min_len) & (n <= max_len))


def quality_report(docs: DataFrame, labels: DataFrame, pass_threshold: float = 0.6) -> DataFrame:
    """E5: per source, score distribution and pass rate, against labels.

    Labels join on doc_id (left); the optimizer picks broadcast or shuffle
    from the size statistics, nothing is forced. Only mergeable aggregates
    (counts, sums, min/max) are used, so a source holding a third of all rows
    costs one partial row per map task.
    """
    scored = docs.select("doc_id", "source", F.round(X.quality_score(F.col("text")), 6)
                         .alias("quality"))
    j = scored.join(labels.select("doc_id", F.col("quality").alias("label_quality")),
                    "doc_id", "left")
    # averages from exact integer sums of micro-units: independent of the
    # order rows arrive in (float sums are not), identical on every engine
    micro = F.round(F.col("quality") * 1_000_000).cast("long")
    good, bad = F.col("label_quality") == 1, F.col("label_quality") == 0

    def avg_of(pred=None):
        m = micro if pred is None else F.when(pred, micro)
        n = F.count(F.lit(1)) if pred is None else F.count_if(pred)
        return F.when(n > 0, F.sum(m) / n / F.lit(1_000_000.0))

    return j.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        avg_of().alias("avg_quality"),
        F.round(F.min("quality"), 6).alias("min_quality"),
        F.round(F.max("quality"), 6).alias("max_quality"),
        F.count_if(F.col("quality") >= pass_threshold).alias("n_pass"),
        F.count("label_quality").alias("n_labeled"),
        F.count_if(good).alias("n_label_good"),
        avg_of(good).alias("avg_quality_label_good"),
        avg_of(bad).alias("avg_quality_label_bad"),
    )


def score_histogram(scored: DataFrame, by: str, score: str = "quality", bins: int = 10) -> DataFrame:
    """E5: per value of ``by``, how many scores fall into each of ``bins``
    equal parts of 0 to 1 (the last one takes 1 itself)."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(F.col(by), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
