"""Document fingerprints: quartile bucket digests of hashed byte triplets.

A window of five bytes moves over the text; its six triplets that hold the
newest byte are hashed into 256 buckets. A bucket's digit is the quartile of
its count among the document's buckets (four digits, two bits each), so the
digest keeps the shape of the counts and not their size. The length is coded
on a logarithmic scale, and a checksum of the buckets tells short texts apart.

Two digests differ by the distance of their digits (a jump between the outer
quartiles counts more) and of their length codes, bounded by the largest
possible difference; likeness is one minus the difference over that bound.

Defined cases: null texts are empty; texts of under five bytes count their
whole bytes as triplets (padded with zeros); empty texts share one digest;
equal texts have equal digests. The next document follows in the order of id
(nulls first) and then text, and the first follows the last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

BUCKETS = 256
#: Offsets (back from the newest byte) of the two older bytes of each triplet.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Difference of two digits by their distance 0..3, and the most that lengths add.
STEP = np.array([0, 1, 2, 6])
LENGTH_CAP = 48
BOUND = int(STEP[3]) * BUCKETS + LENGTH_CAP

_rng = np.random.default_rng(4711)
#: Random permutations of the byte values: one for each place in a triplet and kind of triplet.
TABLE = np.stack([_rng.permutation(256).astype(np.uint8) for _ in range(3 * len(TRIPLETS))]).reshape(len(TRIPLETS), 3, 256)
MIX = _rng.permutation(65536).astype(np.uint16)


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """How many triplets of the bytes fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    if not len(data):
        return counts
    if len(data) < 5:
        data = np.concatenate([data, np.zeros(5 - len(data), np.uint8)])
    for at in range(0, len(data) - 4, 1 << 20):  # long texts in pieces that overlap by four bytes
        x = data[at:at + (1 << 20) + 4]
        new = x[4:]
        for k, (p, q) in enumerate(TRIPLETS):
            t = TABLE[k]
            h = t[0][new] ^ t[1][x[4 - p:len(x) - p]]
            h = MIX[h.astype(np.uint16) << np.uint16(8) | t[2][x[4 - q:len(x) - q]]] & np.uint16(BUCKETS - 1)
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def digest(data: np.ndarray) -> str:
    """Hex: one byte of checksum, one of length, then the digits of the buckets."""
    counts = bucket_counts(data)
    order = np.sort(counts)
    cuts = order[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    digits = (counts[:, None] > cuts[None, :]).sum(axis=1).astype(np.uint8)
    packed = digits[0::4] | digits[1::4] << 2 | digits[2::4] << 4 | digits[3::4] << 6
    length = min(255, int(round(8 * np.log2(1 + len(data)))))
    check = int((counts * np.arange(1, BUCKETS + 1)).sum() % 256)
    return bytes([check, length]).hex() + packed.tobytes().hex()


def difference(a: str, b: str) -> int:
    """Bounded difference score of two digests, 0 to BOUND."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    shifts = np.array([0, 2, 4, 6], np.uint8)
    dx, dy = ((v[2:, None] >> shifts & 3).astype(np.int64) for v in (x, y))
    return int(STEP[np.abs(dx - dy)].sum() + min(LENGTH_CAP, 2 * abs(int(x[1]) - int(y[1]))))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at the largest possible difference."""
    return 1.0 - difference(a, b) / BOUND


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row: the operator by itself."""
    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__text"):
            yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array([digest(data[off[i]:off[i + 1]]) for i in range(rows.num_rows)])], names=["__id", "fingerprint"])

    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return base.mapInArrow(run, base.select("__id", F.lit("").alias("fingerprint")).schema).withColumnRenamed("__id", id_col)


PAIR = "__id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs():
    """Rows come sorted by (bucket, guest, id, text); a guest is the first
    document of the bucket that follows and only lends its text."""
    schema = pa.schema([("__id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def one(did, text, mark, following, next_mark):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        raw = edited.encode()
        edited_mark = digest(np.frombuffer(raw, np.uint8))
        return (did, len(text), hashlib.sha256(raw).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark))

    def run(batches):
        held, bucket, out = None, None, []
        for b in batches:
            for rows, data, off in C.text_pieces([b], "__text"):
                raw = data.tobytes()
                buckets, guests, ids = (rows.column(c).to_pylist() for c in ("bucket", "guest", "__id"))
                for i in range(rows.num_rows):
                    part = raw[off[i]:off[i + 1]]
                    row = (ids[i], part.decode("utf-8", "replace"), digest(np.frombuffer(part, np.uint8)))
                    if buckets[i] != bucket:
                        held, bucket = None, buckets[i]
                    if held is not None:
                        out.append(one(*held, row[1], row[2]))
                    held = None if guests[i] else row  # after the first guest, others with its id find nobody
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
    return run


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the second half
    replaced by the beginning of the next document), and their likeness."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    ids = base.select("__id").where("__id is not null")
    cuts = sorted(set(ids.approxQuantile("__id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cut_col = F.expr(f"array({', '.join(f'{int(c)}L' for c in cuts)})") if cuts else F.array().cast("array<long>")
    bucket = F.when(F.col("__id").isNull(), F.lit(0)).otherwise(F.size(F.filter(cut_col, lambda c: c < F.col("__id"))))
    # the first document of each bucket that has any, one small row for each bucket
    firsts = {r["b"]: r["first"] for r in base.select("__id", bucket.alias("b")).groupBy("b").agg(
        F.struct(F.max(F.col("__id").isNull()).alias("null"), F.min("__id").alias("id")).alias("first")).collect()}
    have = sorted(firsts)
    # it is the guest of the bucket before it (the first follows the last); at most one row per bucket
    guests = spark.createDataFrame([(b, None if firsts[b]["null"] else firsts[b]["id"], have[i - 1]) for i, b in enumerate(have)], "gb int, gid long, host int")
    placed = base.withColumn("b", bucket).join(F.broadcast(guests), (F.col("b") == F.col("gb")) & F.col("__id").eqNullSafe(F.col("gid")), "left")
    placed = placed.select("__id", "__text", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(F.col("b").alias("bucket"), F.lit(False).alias("guest"))))
                                                       .otherwise(F.array(F.struct(F.col("b").alias("bucket"), F.lit(False).alias("guest")),
                                                                          F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))))).alias("p"))
    placed = placed.select("__id", "__text", "p.bucket", "p.guest").repartitionById(max(1, len(cuts) + 1), "bucket")
    return placed.sortWithinPartitions("bucket", "guest", "__id", "__text").mapInArrow(_pairs(), PAIR).withColumnRenamed("__id", id_col)
