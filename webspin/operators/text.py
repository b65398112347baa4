"""Text jobs over DataFrames (one projection each, native except NFKD)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.functions import text as X


def clean_text(df: DataFrame, col: str = "text", out: str = "clean_text") -> DataFrame:
    """NFKD + control removal + whitespace collapse + trim."""
    return df.withColumn(out, X.clean_text(F.col(col)))


def clean_snippets(df: DataFrame, col: str = "snippet", out: str | None = None) -> DataFrame:
    """Tag strip, whitespace collapse, five entities decoded in order."""
    return df.withColumn(out or col, X.clean_snippet(F.col(col)))


def fold_ascii(df: DataFrame, cols, suffix: str = "") -> DataFrame:
    """C4: C1 then drop non-ASCII, applied to every named field."""
    for c in ([cols] if isinstance(cols, str) else cols):
        df = df.withColumn(c + suffix, X.fold_ascii(F.col(c)))
    return df


def content_hash(df: DataFrame, col: str = "text", out: str = "content_hash") -> DataFrame:
    """md5 of the C1-cleaned text; '' for empty text."""
    cleaned = X.clean_text(F.col(col))
    return df.withColumn(out, F.when(cleaned == "", F.lit("")).otherwise(F.md5(cleaned)))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """Groups of exact copies (after cleaning), with their smallest id.

    A partial aggregate per map task precedes the shuffle, so even a hash held
    by a third of all rows moves one partial row per task.
    """
    return (content_hash(df.select(id_col, col), col)
            .where(F.col("content_hash") != "")
            .groupBy("content_hash")
            .agg(F.count(F.lit(1)).alias("n_copies"),
                 F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
            .where(F.col("n_copies") > 1))


def reading_stats(df: DataFrame, col: str = "text", helper: bool = True) -> DataFrame:
    """Word count and reading minutes (half-even rounding).

    ``helper=True`` gives 0 minutes for empty text (utility form); the
    extractor form gives at least 1.
    """
    t = F.col(col)
    words = X.word_count(t)
    empty = (F.coalesce(t, F.lit("")) == "") if helper else None
    return df.withColumn("words", words) \
        .withColumn("reading_minutes", X.reading_minutes(F.col("words"), empty))


def detect_language(df: DataFrame, col: str = "text", mode: str = "page",
                    out: str = "detected") -> DataFrame:
    """Word-list language guess; mode 'page' (extractor) or 'text' (helper)."""
    return df.withColumn(out, X.detect_language(F.col(col), mode))


def language_mix(df: DataFrame, label_col: str = "lang", col: str = "text",
                 mode: str = "page") -> DataFrame:
    """Confusion counts of C7 against a given label."""
    return (df.select(label_col, X.detect_language(F.col(col), mode).alias("detected"))
            .groupBy(label_col, "detected").agg(F.count(F.lit(1)).alias("n")))


def drop_low_quality_lines(df: DataFrame, col: str = "text", out: str = "kept_text") -> DataFrame:
    """Drop lines that are nav words, 'click here'-like, digits or symbols only.

    Each line is tested trimmed and lower-cased.
    """
    lines = F.split(F.coalesce(F.col(col), F.lit("")), "\n")
    kept = F.filter(lines, lambda ln: ~X.low_quality_line(F.lower(F.trim(ln))))
    return df.withColumn("_lines", lines).withColumn("_kept", kept) \
        .withColumn(out, F.array_join("_kept", "\n")) \
        .withColumn("n_lines", F.size("_lines")) \
        .withColumn("n_dropped", F.size("_lines") - F.size("_kept")) \
        .drop("_lines", "_kept")


SENTENCE_SPLIT = "[.?!] "


def bound_sentences(df: DataFrame, col: str = "text", min_len: int = 10,
                    max_len: int = 1000, out: str = "bounded_text") -> DataFrame:
    """Keep sentences whose length lies in [min_len, max_len]."""
    sents = F.split(F.coalesce(F.col(col), F.lit("")), SENTENCE_SPLIT)
    kept = F.filter(sents, lambda s: (F.length(s) >= min_len) & (F.length(s) <= max_len))
    return df.withColumn("n_sentences", F.size(sents)) \
        .withColumn("n_kept", F.size(kept)) \
        .withColumn(out, F.array_join(kept, ". "))


URL_RE = "https?://[^" + X.WS_CLASS[1:-1] + "<>\"']+"
EMAIL_RE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


def mask_urls_emails(df: DataFrame, col: str = "text", urls: bool = True,
                     emails: bool = True, out: str = "masked_text") -> DataFrame:
    """C11: remove URLs and/or e-mail addresses (both switches off by default
    in the reference config; the job exposes them)."""
    t = F.coalesce(F.col(col), F.lit(""))
    out_df = df.withColumn("n_urls", F.regexp_count(t, F.lit(URL_RE))) \
        .withColumn("n_emails", F.regexp_count(t, F.lit(EMAIL_RE)))
    m = t
    if urls:
        m = F.regexp_replace(m, URL_RE, "")
    if emails:
        m = F.regexp_replace(m, EMAIL_RE, "")
    return out_df.withColumn(out, m)


# Fixed values that must equal the reference (field caps, in characters).
FIELD_CAPS = {"title": 200, "snippet": 300, "tool_input": 500, "observation": 300,
              "error": 200, "source": 200}


def truncate_fields(df: DataFrame, spec: dict[str, tuple[str, int]]) -> DataFrame:
    """``spec`` maps out column -> (in column, max chars)."""
    for out, (col, n) in spec.items():
        df = df.withColumn(out, F.substring(F.col(col), 1, n))
    return df

