"""Helpers shared by the operators of this subpackage: zero-copy byte views of
Arrow string columns, vectorised rolling hashes, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: One 64-bit value per byte, from a fixed seed.
BYTE_VALUE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``. Where
    that is unset, a local session gets a temporary folder (and uses it for
    checkpoints too); any other master is refused."""
    base = shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="webspin-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def write_read(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lowest(rows: DataFrame, by: str, order: list[str], k: int, slices: int = 256) -> DataFrame:
    """The first ``k`` rows of each value of ``by`` in ``order``. The first column of
    the order is a hash: its slices are cut to k before a value's rows meet, so
    that a hot value is no single task."""
    part = F.pmod(F.col(order[0]), F.lit(slices))
    few = rows.withColumn("__slice", part).withColumn("__rn", F.row_number().over(Window.partitionBy(by, "__slice").orderBy(*order))).where(F.col("__rn") <= k)
    return few.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rn") <= k).drop("__slice", "__rn")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def string_view(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer row stands alone)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def text_pieces(batches, column: str, limit: int = 1 << 20):
    """(batch slice, bytes, offsets) of at most ``limit`` bytes of text each,
    so that the arrays made from a piece stay small."""
    for batch in batches:
        data, off = string_view(batch.column(column))
        for a, b in row_pieces(off, limit):
            yield batch.slice(a, b - a), data[off[a]:off[b]], off[a:b + 1] - off[a]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with ``span_hash(P, a, b)`` the hash of data[a:b]."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], equal for equal bytes at any place."""
    return mix((prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Maximal runs of word bytes inside each row: (start, end, row)."""
    mask = is_word[data]
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, for a Spark long."""
    return np.ascontiguousarray(h, dtype=U64).view(np.int64)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
