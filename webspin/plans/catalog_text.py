"""Registered queries: text (C1-C12), quality (E1-E5, D2 native) and X12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspin.functions import text as X
from webspin.operators import quality as Q
from webspin.operators import text as T
from webspin.plans import corpus
from webspin.sources.tables import load


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def q_c1(spark: SparkSession, sf: str) -> DataFrame:
    d = T.clean_text(_docs(spark, sf).select("doc_id", "text"))
    folded = X.fold_ascii_of_clean(F.col("clean_text"))
    return d.select("doc_id", F.md5(folded).alias("clean_ascii_md5"),
                    X.word_count(F.col("clean_text")).alias("words"))


def q_c2(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages").select("page_id", "html")
    s = T.clean_snippets(p, "html", "snippet")
    return s.select("page_id", F.length("snippet").alias("snippet_len"),
                    F.md5("snippet").alias("snippet_md5"))


def q_c4(spark: SparkSession, sf: str) -> DataFrame:
    d = T.fold_ascii(_docs(spark, sf).select("doc_id", "text"), "text", "_ascii")
    return d.select("doc_id", F.col("text_ascii").alias("ascii_text"),
                    F.length("text_ascii").alias("ascii_len"))


def q_c5(spark: SparkSession, sf: str) -> DataFrame:
    return T.exact_duplicates(_docs(spark, sf)).select("n_copies", "first_id", "last_id")


def q_c6(spark: SparkSession, sf: str) -> DataFrame:
    return T.reading_stats(_docs(spark, sf).select("doc_id", "text")) \
        .select("doc_id", "words", "reading_minutes")


def q_c7(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", "lang", "text")
    d = T.detect_language(d, mode="page", out="detected_page")
    d = T.detect_language(d, mode="text", out="detected_text")
    return d.select("doc_id", "lang", "detected_page", "detected_text")


def q_c8(spark: SparkSession, sf: str) -> DataFrame:
    return T.language_mix(_docs(spark, sf))


def q_c9(spark: SparkSession, sf: str) -> DataFrame:
    d = T.drop_low_quality_lines(_docs(spark, sf).select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.length("kept_text").alias("kept_len"))


def q_c10(spark: SparkSession, sf: str) -> DataFrame:
    d = T.bound_sentences(_docs(spark, sf).select("doc_id", "text"))
    return d.select("doc_id", "n_sentences", "n_kept", F.length("bounded_text").alias("kept_len"))


def q_c11(spark: SparkSession, sf: str) -> DataFrame:
    d = T.mask_urls_emails(_docs(spark, sf).select("doc_id", "text"))
    return d.select("doc_id", "n_urls", "n_emails", F.length("masked_text").alias("masked_len"))


def q_c12(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    caps = T.FIELD_CAPS
    d = T.truncate_fields(c, {"as_source": ("text", caps["source"]),
                              "as_observation": ("text", caps["observation"]),
                              "as_tool_input": ("text", caps["tool_input"])})
    return d.select("conv_id", "turn", "as_source", "as_observation", "as_tool_input")


def q_e1(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_scores(_docs(spark, sf).select("doc_id", "text")).select("doc_id", "quality")


def q_e2(spark: SparkSession, sf: str) -> DataFrame:
    return Q.valid_content(_docs(spark, sf).select("doc_id", "text")).select("doc_id", "valid")


def _doc_records(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", "source",
                    F.trim(F.split("text", "\n").getItem(0)).alias("title"),
                    F.col("text").alias("main_content"),
                    Q.url_page_type(F.col("source")).alias("page_type"))


def q_e3(spark: SparkSession, sf: str) -> DataFrame:
    v = Q.validate_extraction(_doc_records(spark, sf))
    return v.select("doc_id", F.coalesce("page_type", F.lit("article")).alias("page_type"),
                    "extraction_success")


def q_e4(spark: SparkSession, sf: str) -> DataFrame:
    return Q.length_window(_docs(spark, sf)).select("doc_id", F.length("text").alias("n_chars"))


def q_e5(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_report(_docs(spark, sf), load(spark, sf, "labels"))


def q_e5_source_histogram(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("source", F.round(X.quality_score(F.col("text")), 6).alias("quality"))
    return Q.score_histogram(d, "source")


def q_e5_type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    p = Q.page_types(load(spark, sf, "pages").select("page_id", "url", "html"))
    p = p.select("page_type", X.clean_snippet(F.col("html")).alias("text"))
    return Q.score_histogram(p.select("page_type", F.round(X.quality_score(F.col("text")), 6).alias("quality")), "page_type")


def q_d2(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages").select("page_id", "url", "html")
    return Q.page_types(p).select("page_id", "page_type")


def q_x12(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.curate_corpus(_docs(spark, sf))


QUERIES = {
    "C1_clean_text": q_c1,
    "C2_clean_snippets": q_c2,
    "C4_fold_ascii": q_c4,
    "C5_exact_duplicates": q_c5,
    "C6_reading_stats": q_c6,
    "C7_detect_language": q_c7,
    "C8_language_mix": q_c8,
    "C9_drop_low_quality_lines": q_c9,
    "C10_bound_sentences": q_c10,
    "C11_mask_urls_emails": q_c11,
    "C12_truncate_fields": q_c12,
    "E1_quality_scores": q_e1,
    "E2_valid_content": q_e2,
    "E3_validate_extraction": q_e3,
    "E4_length_window": q_e4,
    "E5_quality_report": q_e5,
    "E5_source_histogram": q_e5_source_histogram,
    "E5_page_type_histogram": q_e5_type_histogram,
    "D2_page_types": q_d2,
    "X12_curate_corpus": q_x12,
}
