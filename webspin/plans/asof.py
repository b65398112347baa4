"""As-of join: for each probe the latest fact of its key at or before its time.

Facts and probes are one union, dealt out by (key, time bucket), so a hot key is
split by time. The last fact of each bucket is a partial aggregate; a window over
these few rows per key carries it over empty buckets and the borders, as one more
row of each later bucket; a window inside the bucket takes the last fact before
each probe. No range join and no Python. Null keys and null times match nothing;
of facts at one time the one with the greatest values counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webspin.plans.scan import HOUR_US, order_value


def as_of(probes: DataFrame, facts: DataFrame, key: str, time: str, values: list[str], fact_key: str | None = None, fact_time: str | None = None,
          fact_time_as: str | None = None, width: int = HOUR_US) -> DataFrame:
    """All rows and columns of ``probes`` with ``values`` of the latest fact (null
    without one) and, with ``fact_time_as``, its time. ``width`` is the bucket width in
    units of the time (times: microseconds)."""
    fact_key, fact_time = fact_key or key, fact_time or time
    clash = {*values, *([fact_time_as] if fact_time_as else [])} & set(probes.columns)
    if clash:
        raise ValueError(f"names that the probes have already: {sorted(clash)}")
    fact = F.struct(F.col(fact_time).alias("_time"), *values)
    right = (facts.where(F.col(fact_key).isNotNull() & F.col(fact_time).isNotNull())
             .select(F.col(fact_key).cast(probes.schema[key].dataType).alias("_k"), order_value(facts, fact_time).alias("_t"), fact.alias("_f")))
    left = probes.select(F.col(key).alias("_k"), order_value(probes, time).alias("_t"), F.struct(*probes.columns).alias("_p"))
    bucket = F.floor(F.col("_t") / F.lit(width)).cast("long").alias("_b")
    right, left = right.select("*", bucket), left.select("*", bucket)
    # the last fact of each (key, bucket), and every bucket that has probes
    last = right.groupBy("_k", "_b").agg(F.max_by("_f", F.struct("_t", "_f")).alias("_f"))
    cells = last.unionByName(left.where("_k is not null and _t is not null").select("_k", "_b").distinct(), allowMissingColumns=True)
    cells = cells.groupBy("_k", "_b").agg(F.max("_f").alias("_f"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("_k", "_b", F.last("_f", ignorenulls=True).over(before).alias("_f")).where("_f is not null").withColumn("_side", F.lit(0))
    rows = carried.unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True).unionByName(left.withColumn("_side", F.lit(2)), allowMissingColumns=True)
    # the carried row comes first (no time), and a fact before a probe of its time
    upto = Window.partitionBy("_k", "_b").orderBy(F.col("_t").asc_nulls_first(), "_side", "_f").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_v", F.last("_f", ignorenulls=True).over(upto)).where("_side = 2")
    out = [F.col(f"_p.`{c}`").alias(c) for c in probes.columns] + [F.col(f"_v.`{c}`").alias(c) for c in values]
    return found.select(*out, *([F.col("_v._time").alias(fact_time_as)] if fact_time_as else []))
