"""Keyed running sums and maxima that stay parallel under key skew.

A ``Window.partitionBy(key).orderBy(t)`` running aggregate sends every row of
a key to one task; if one key holds a third of all rows, one task does a third
of the work. Here the order column itself cuts each key into buckets of a
fixed width (``floor(order / width)``), a value of the row and not of the
plan:

1. totals per (key, bucket): a partial aggregation per task;
2. a window over those few totals per key gives each bucket its offset;
3. a join on (key, bucket) brings the offset to the rows;
4. a window inside (key, bucket) adds the running value; it needs the
   partitioning of the join, so that the rows are shuffled once.

All steps are native, integers stay integers, null keys are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bucket widths: one hour in microseconds; ids and turns.
HOUR_US, IDS = 3_600_000_000, 65_536


def order_value(df: DataFrame, col: str) -> Column:
    """The order column as a long: times in microseconds."""
    if isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    return F.col(col).cast("long")


def keyed_prefix(df: DataFrame, key: str, order: list[str], val: str, out: str, op: str = "sum",
                 inclusive: bool = True, width: int = HOUR_US) -> DataFrame:
    """Running ``op`` (sum | max) of ``val`` per ``key`` in ``order``.

    ``inclusive=False`` gives the aggregate of the rows strictly before (sum:
    0 for the first row; max: null). ``width`` is the bucket width in units of
    the first order column (rows with a null there come first).
    """
    agg = F.max if op == "max" else F.sum
    zero = F.lit("").cast(df.schema[key].dataType) if isinstance(df.schema[key].dataType, T.StringType) else F.lit(0).cast(df.schema[key].dataType)
    at = F.floor(order_value(df, order[0]) / F.lit(width)).cast("long")
    cut = df.withColumns({"_kv": F.coalesce(F.col(key), zero), "_kn": F.col(key).isNull(),
                          "_kb": F.coalesce(at, F.lit(-(1 << 62)))})
    cell = ["_kv", "_kn", "_kb"]
    before = Window.partitionBy("_kv", "_kn").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*cell).agg(agg(val).alias("_kt"))
               .select(*cell, agg("_kt").over(before).alias("_ko")).where(F.col("_ko").isNotNull()))
    w = Window.partitionBy(*cell).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = agg(val).over(w)
    res = F.greatest(local, F.col("_ko")) if op == "max" else F.coalesce(local, F.lit(0)) + F.coalesce("_ko", F.lit(0))
    return cut.join(offsets, cell, "left").withColumn(out, res).drop(*cell, "_ko")
