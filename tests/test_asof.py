"""As-of join and the stateful streams against brute force and the batch forms."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from webspin.operators import limits as I
from webspin.operators import sessions as J
from webspin.plans.asof import as_of
from webspin.sources import tables as T
from webspin.streaming import stateful as S


def test_as_of_equals_brute_force(spark):
    rng = random.Random(6)
    facts = [(rng.choice("aab"), rng.randint(0, 400), i) for i in range(60)] + [("c", 5, 900), (None, 1, 901), ("a", None, 902), ("a", 10, 903), ("a", 10, 904)]
    probes = [(i, rng.choice("aaabd"), rng.randint(-20, 500)) for i in range(300)] + [(900, "c", 5), (901, None, 50), (902, "a", None), (903, "a", 10), (903, "a", 10), (904, "c", 4)]
    left = spark.createDataFrame(probes, "id int, k string, t long").repartition(4)
    right = spark.createDataFrame(facts, "k string, t long, v int")

    def want(k, t):
        good = [(u, v) for key, u, v in facts if k is not None and key == k and u is not None and t is not None and u <= t]
        return max(good, default=(None, None))
    for width in (1, 50, 10_000):
        got = as_of(left, right, "k", "t", ["v"], fact_time_as="since", width=width).collect()
        assert sorted(map(tuple, got), key=str) == sorted(((i, k, t, want(k, t)[1], want(k, t)[0]) for i, k, t in probes), key=str)
    assert as_of(left, right.where("false"), "k", "t", ["v"]).where("v is not null").count() == 0
    assert as_of(left.where("false"), right, "k", "t", ["v"]).count() == 0
    with pytest.raises(ValueError, match="names that the probes have"):
        as_of(left, right.withColumnRenamed("v", "id"), "k", "t", ["id"])


def test_as_of_plan_splits_a_hot_key(spark):
    left = spark.range(10).selectExpr("'a' k", "id t")
    plan = as_of(left, left.withColumn("v", F.lit(1)), "k", "t", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "hashpartitioning(_k" in plan


def run_stream(spark, frames, job, name, mode="append"):
    """Rows of a stream over one file per frame, in order."""
    S.use_rocksdb(spark)
    src, ck = tempfile.mkdtemp(prefix="webspin-s-", dir="/tmp"), tempfile.mkdtemp(prefix="webspin-c-", dir="/tmp")
    import time
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken by their time of change
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = job(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.sql(f"SELECT * FROM {name}").collect()


LOG = "event_id long, identifier long, ts timestamp"


def log_frames(spark, parts=2):
    """A log in files, out of order by up to 20 minutes."""
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 6), 1_700_000_000 + i * 160 + rng.randint(0, 130)) for i in range(150)]
    rows += [(10_000 + i, 99, 1_700_000_000 + i) for i in range(5)]  # goes idle early
    rows = sorted(rows, key=lambda r: r[2] + rng.randint(0, 1200))
    cut = len(rows) // parts
    frames = [spark.createDataFrame(rows[i * cut:(i + 1) * cut if i < parts - 1 else None], "event_id long, identifier long, s long") for i in range(parts)]
    return [f.select("event_id", "identifier", F.timestamp_seconds("s").alias("ts")) for f in frames], rows


def test_exact_window_stream_equals_batch(spark):
    frames, rows = log_frames(spark)
    got = run_stream(spark, frames, lambda s: S.window_counts_stream(s, 1800, 3, watermark="30 minutes"), "exact_counts")
    whole = frames[0].unionByName(frames[1])
    passed = (max(r[2] for r in rows) - 1800) // 1800 * 1800  # buckets that the watermark has passed
    batch = I.window_counts(whole, 1800, 3).where(F.unix_seconds("ts") < passed)
    pick = lambda rs: sorted((r.identifier, r.event_id, r.ts, r.n_in_window, r.violation) for r in rs)
    assert pick(got) == pick(batch.collect()) and len(got) > 100 and any(r.violation for r in got)


def test_idle_stream_equals_batch(spark):
    frames, rows = log_frames(spark)
    got = run_stream(spark, frames, lambda s: S.expire_idle_stream(s, 3600, watermark="30 minutes"), "idle_keys")
    mark = max(r[2] for r in rows) - 1800
    whole = frames[0].unionByName(frames[1])
    batch = I.expire_idle(whole, F.timestamp_seconds(F.lit(mark)), 3600).where("expired")
    assert sorted((r.identifier, r.last_ts) for r in got) == sorted((r.identifier, r.last_ts) for r in batch.collect()) == [(99, got[0].last_ts)]
    assert all(r.dropped_at > r.last_ts for r in got)


def test_session_memory_stream_equals_batch(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"text {c} {t}") for c in range(8) for t in range(rng.randint(1, 15))]
    rng.shuffle(rows)
    frames = [spark.createDataFrame(rows[i::3], "conv_id long, turn int, role string, text string") for i in range(3)]
    got = run_stream(spark, frames, S.chat_history_stream, "chat_memory", "update")
    batch = {r.conv_id: r.history for r in J.chat_history(frames[0].unionByName(frames[1]).unionByName(frames[2])).collect()}
    last = {}
    for r in got:
        last[r.conv_id] = r.history  # batches come in order
    assert last == batch


def test_stream_sink_writes_a_replayed_epoch_once(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "id % 3 AS part")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(src)
    for ck in ("a", "b"):  # the second query knows nothing of the first: it runs epoch 0 again
        stream = spark.readStream.schema(rows.schema).parquet(src)
        T.write_stream_corpus(stream, out, str(tmp_path / ck), ["part"]).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(map(tuple, T.read_stream_corpus(spark, out).select("id", "part").collect())) == sorted(map(tuple, rows.collect()))
