"""Cleaning pipeline over ``documents``: a chain of operators of webspin.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webspin.llm import common, op3_quality, op5_suffix_dedup, op8_decontaminate, op9_near_dedup, op10_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (null and empty texts
    among them). A repeated row is judged like its copy."""
    return op3_quality.keep_good(docs, op3_quality.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (sets of five words,
    likeness of 0.8 or more). Texts without words have no copies; rows without
    an id stay."""
    return op9_near_dedup.drop_near_duplicates(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat go from the texts, all copies
    of them: maximal runs of bytes that are covered by 200-byte strings
    which start more than once, if a run holds 50 words (between white space).
    200 bytes are 50 words of three letters; repeated passages of shorter
    words stay. Null texts stay null; a text may become empty."""
    return op5_suffix_dedup.remove_repeats(docs, window=200, core=64, words=50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go (of all its
    words, if it has fewer). Null items and texts have no words."""
    return op8_decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text; a null
    text counts as empty."""
    return op10_bpe.digests(op10_bpe.encode_decode(docs))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.write_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express these stages; tests/llm/test_pipeline.py compares each and run() with
#: brute force (the first with the scores of its own classifier).
ORACLE_SQL = None
