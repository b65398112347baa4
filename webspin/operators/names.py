"""Rows whose text contains any of many names, without a nested loop.

Every name is filed under one of its grams (three letters; the whole name, if it is
shorter), the one that the fewest names have. The grams of the distinct texts
are joined to the names by equality, and what shares a gram is confirmed. Rows
then join the texts that were hit. No side is broadcast by a hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3


def _grams(c: Column, q: int = Q) -> Column:
    """Distinct grams of exactly ``q`` code points."""
    return F.when(F.char_length(c) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - q + 1), lambda i: F.substring(c, i, F.lit(q))))) \
        .otherwise(F.array().cast("array<string>"))


def filed_names(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(gram, name): each distinct name under its rarest gram."""
    one = names.select(F.col(name_col).alias("name")).where("name is not null").distinct()
    every = one.select("name", F.explode(F.when(F.char_length("name") < Q, F.array("name")).otherwise(_grams(F.col("name")))).alias("gram"))
    count = every.groupBy("gram").agg(F.count("*").alias("n"))
    return every.join(count, "gram").groupBy("name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("gram", "name")


def texts_with_names(texts: DataFrame, names: DataFrame, text_col: str) -> DataFrame:
    """Distinct non-null texts that contain a name. The empty name is in all."""
    distinct = texts.select(F.col(text_col).alias("_text")).where("_text is not null").distinct()
    pieces = F.concat(F.array(F.lit("")), *[_grams(F.col("_text"), q) for q in range(1, Q + 1)])
    filed = filed_names(names)
    near = distinct.select("_text", F.explode(pieces).alias("gram")).join(filed, "gram")
    return near.where(F.instr(F.col("_text"), F.col("name")) > 0).select("_text").distinct()


def with_names(df: DataFrame, names: DataFrame, text_col: str, keep: bool) -> DataFrame:
    """Rows whose text contains a name (``keep``), or those that contain none
    (a null text among them)."""
    hit = texts_with_names(df, names, text_col)
    return df.join(hit, df[text_col] == hit["_text"], "left_semi" if keep else "left_anti")
