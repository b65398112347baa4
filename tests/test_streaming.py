import tempfile

from pyspark.sql import functions as F

from webspin.operators import cache as H
from webspin.sources.tables import SCHEMAS
from webspin.streaming import streams as S


def test_cache_stream_equals_batch(spark):
    from tests.conftest import SMOKE

    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    src = tempfile.mkdtemp(prefix="webspin-stream-src-", dir="/tmp")
    ev.write.mode("overwrite").parquet(src)
    ck = tempfile.mkdtemp(prefix="webspin-stream-ck-", dir="/tmp")
    stream = spark.readStream.schema(SCHEMAS["events"]).parquet(src) \
        .withColumn("success", F.col("event_type") != "error")
    out = S.cache_hits_stream(stream, "event_type", ttl_s=3600.0, watermark="100 days")
    q = (out.writeStream.format("memory").queryName("cache_stream").outputMode("append")
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.event_id: r.hit for r in spark.sql("SELECT * FROM cache_stream").collect()}
    batch = H.cache_hits(ev.withColumn("success", F.col("event_type") != "error"), 3600.0,
                         key="event_type").collect()
    assert got == {r.event_id: r.hit for r in batch}


def test_windowed_streams(spark):
    from tests.conftest import SMOKE

    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    src = tempfile.mkdtemp(prefix="webspin-stream-src2-", dir="/tmp")
    ev.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(SCHEMAS["events"]).parquet(src)
    ts = F.col("ts").cast("timestamp")
    jobs = {"daily": (S.daily_tool_stats_stream, lambda e: e.groupBy(F.window("ts", "1 day")).agg(
                F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("successful")), 86_400),
            "sess": (S.session_metrics_stream, lambda e: e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(
                F.count(F.lit(1)).alias("actions"), F.count_if(F.col("event_type") != "error").alias("steps")), 3600),
            "wins": (S.window_counts_stream, lambda e: e.groupBy("user_id", F.window("ts", "60 seconds", "10 seconds")).agg(
                F.count(F.lit(1)).alias("n")), 60)}
    for name, (job, batch, late) in jobs.items():
        ck = tempfile.mkdtemp(prefix=f"webspin-{name}-ck-", dir="/tmp")
        q = (job(stream).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(120)
        last = ev.agg(F.max(F.unix_micros(ts))).first()[0]
        full = batch(ev.withColumn("ts", ts))
        w = next(c for c in full.columns if "window" in c)
        # what the watermark has passed is emitted, and equals the batch result
        done = full.where(F.unix_micros(F.col(w)["end"]) <= last - late * 1_000_000)
        key = lambda r: str(r)
        got = sorted(spark.sql(f"SELECT * FROM {name}").collect(), key=key)
        assert got and got == sorted(done.collect(), key=key), name


def test_limiter_stream_equals_batch(spark):
    from tests.conftest import SMOKE
    from webspin.operators import limits as I
    from webspin.plans.catalog_logs import _hourly_limits
    from webspin.sources.derived import request_log

    log = request_log(spark, SMOKE)
    src = tempfile.mkdtemp(prefix="webspin-stream-rl-", dir="/tmp")
    log.write.mode("overwrite").parquet(src)
    ck = tempfile.mkdtemp(prefix="webspin-stream-rl-ck-", dir="/tmp")
    rows = [r.asDict() for r in _hourly_limits(spark).collect()]
    stream = spark.readStream.schema(log.schema).parquet(src)
    q = (S.replay_limits_stream(stream, rows, watermark="100 days").writeStream.format("memory")
         .queryName("limiter_stream").outputMode("append").option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.event_id: (r.allowed, r.counted_block) for r in spark.sql("SELECT * FROM limiter_stream").collect()}
    batch = I.replay_limits(log, _hourly_limits(spark)).collect()
    assert got == {r.event_id: (r.allowed, r.counted_block) for r in batch}
    assert any(not a for a, _ in got.values())


def test_dedupe_stream(spark):
    from tests.conftest import SMOKE

    pages = spark.read.parquet(f"{SMOKE}/pages.parquet").select("page_id", "url") \
        .withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    src = tempfile.mkdtemp(prefix="webspin-stream-pages-", dir="/tmp")
    pages.write.mode("overwrite").parquet(src)
    ck = tempfile.mkdtemp(prefix="webspin-stream-pages-ck-", dir="/tmp")
    stream = spark.readStream.schema(pages.schema).parquet(src)
    q = (S.dedupe_urls_stream(stream).writeStream.format("memory").queryName("dedupe_stream")
         .outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(120)
    from webspin.functions import urls as U

    n_unique = pages.select(U.canonical_url(F.col("url"))).distinct().count()
    assert spark.sql("SELECT count(*) FROM dedupe_stream").first()[0] == n_unique
