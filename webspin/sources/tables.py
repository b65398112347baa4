"""A1, A2, A10: table scans, fetch outcomes and the corpus sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webspin.session import table_path

# Explicit schemas: no inference on a 100 TB scan.
SCHEMAS: dict[str, T.StructType] = {
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]),
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]),
}


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan to a number of partitions (default: the cluster's
    parallelism), for tables stored as one unsplittable row group. Filters and
    column pruning still push below it. For callers that know their input:
    ``load`` never does it by itself."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    return df.repartition(want)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A1: scan one table. Known tables get an explicit schema. The reader's
    split size decides the tasks; a session that knows its tables are single
    unsplittable row groups asks for ``spread`` by setting
    ``webspin.spreadScans`` to a number of partitions."""
    reader = spark.read
    if table in SCHEMAS:
        reader = reader.schema(SCHEMAS[table])
    df = reader.parquet(table_path(sf_dir, table))
    want = int(spark.conf.get("webspin.spreadScans", "0"))
    return spread(df, want) if want else df


MAX_BYTES = 10 * 1024 * 1024


def fetch_outcomes(fetches: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A2: the outcome of each fetch.

    Input columns: url, status_code int, content string, and optionally
    ``declared_length`` (the content-length header). Success iff
    200 <= status < 400; error ``HTTP n``; a declared size over the cap fails
    with ``Response too large``; a body over the cap is cut; an invalid URL
    (no host after canonicalisation) gives status 0.
    """
    from webspin.functions.urls import canonical_url, url_host

    declared = (F.col("declared_length") if "declared_length" in fetches.columns
                else F.lit(None).cast("long"))
    host = url_host(canonical_url(F.col("url")))
    valid = F.col("url").isNotNull() & (F.col("url") != "") & (host != "")
    too_large = declared.isNotNull() & (declared > F.lit(max_bytes))
    status = F.when(valid, F.col("status_code")).otherwise(F.lit(0))
    ok = valid & ~too_large & (status >= 200) & (status < 400)
    error = (F.when(~valid, F.lit("Invalid URL"))
             .when(too_large, F.concat(F.lit("Response too large: "),
                                       declared.cast("string"), F.lit(" bytes")))
             .when(~ok, F.concat(F.lit("HTTP "), status.cast("string"))))
    content = (F.when(~valid | too_large, F.lit(""))
               .otherwise(F.substring(F.col("content"), 1, max_bytes)))
    return fetches.select(
        *[c for c in fetches.columns if c not in ("status_code", "content")],
        status.alias("status_code"), content.alias("content"),
        ok.alias("success"), error.alias("error"),
        (F.floor(status / 100) * 100).cast("int").alias("status_class"),
    )


def write_corpus(df: DataFrame, path: str, partition_by: list[str] | None = None,
                 mode: str = "overwrite") -> None:
    """A10: write a corpus table as parquet, partitioned for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


EPOCH = "_epoch"


def write_stream_corpus(stream_df: DataFrame, path: str, checkpoint: str,
                        partition_by: list[str] | None = None):
    """A10 streaming form, exactly once: each micro-batch owns the folder of its
    epoch. A batch that is run again after a failure overwrites that folder, so
    its rows are there once. ``read_stream_corpus`` reads the table."""

    def sink(batch: DataFrame, epoch: int) -> None:
        write_corpus(batch, f"{path.rstrip('/')}/{EPOCH}={epoch}", partition_by, mode="overwrite")

    return (stream_df.writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint))


def read_stream_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The rows that write_stream_corpus has written, without the epoch."""
    return spark.read.parquet(path).drop(EPOCH)
