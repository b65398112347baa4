"""Registered queries of the operators in this subpackage. Each reads its whole
table and returns its operator's full result in the fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bucket5(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5: the folds of the learned operators."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from webspin.llm.op1_language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    models = train(docs.where(bucket5() != 0), "doc_id", "text", "lang")
    return identify(docs, models).select("doc_id", F.coalesce(bucket5() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", F.col("rejected"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from webspin.llm.op2_toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    index = train(docs, table(spark, sf_dir, "labels"), bucket5() != 0)
    return score_toxicity(docs, index).select("doc_id", F.coalesce(bucket5() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.op3_quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from webspin.llm.op4_lm_score import score_texts, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket5() == 1, F.lit(False))
    model, counts = train(docs.where(~held_out))
    return score_texts(docs, held_out, model, counts)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.op5_suffix_dedup import dedup_suffixes

    return dedup_suffixes(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.op6_html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.op7_fingerprint import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.op8_decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.op9_near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.op10_bpe import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents")))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.common import scratch_path
    from webspin.llm.op11_token_files import digests, read_tokens, write_tokens

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(read_tokens(spark, path))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webspin.llm.op12_spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from webspin.llm.op13_hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)[0]


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_lm_score": op4_lm_score,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_text": op6_html_text,
    "op7_fingerprint": op7_fingerprint,
    "op8_decontaminate": op8_decontaminate,
    "op9_near_dedup": op9_near_dedup,
    "op10_bpe": op10_bpe,
    "op11_token_files": op11_token_files,
    "op12_spelling": op12_spelling,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {}
