"""Hard negatives for contrastive training, by angular triangle filtering.

The index holds every vector as whole numbers, with its norm and its angles to
some reference directions, in blocks sorted by label, nearest reference and
angle. A block is cut into windows of rows; a window knows the least and the
greatest norm and angle to each reference. For an anchor at angle p to a
reference and a row at angle q, the angle between the two lies between |p - q|
and min(p + q, 2 pi - p - q). The references' intervals are intersected, turned
into cosines, multiplied by norms and widened by more than the rounding error.
Only windows whose score bounds overlap what an anchor still looks for are
scored, by inner products of whole numbers.

A first pass over the index finds the positives of each anchor, a second one
the negatives in the score windows that the positives set. Anchors go through in
blocks of ``ANCHORS``; a task keeps the best few of each anchor and passes on
just these.

Equal vectors of one label are one row of the index with their smallest ids
(as many as a result can name), so a group of copies of any size is one row.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component take no part; a vector that is shorter than others counts as filled
up with zeros; rows that repeat an id, label and vector count once; rows that
share an id are never partners, and each such row whose id makes it an anchor
gets results of its own; ties of scores go to the smaller id. Scores are
exact as long as they fit a 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webspin.llm import common as C

#: Rows of a block of the index, rows of a window, anchors that are broadcast together.
BLOCK, WINDOW, ANCHORS = 1024, 64, 4096
#: Reference directions, and the rows that they are chosen from (those of least hash).
REFERENCES, SAMPLE = 16, 2048
#: Added to every bound, relative to the product of the norms: far above the rounding error of angles kept in 32 bits.
SLACK = 4e-6
NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, anchor, v): the rows that take part, v the whole numbers
    floor(scale * x)."""
    x = F.col("__v")
    good = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                       F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("__v"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(good)
    return base.select("id", "label", "anchor", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(vectors) -> np.ndarray:
    """int64 rows of a list<int64> column, filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = vectors.flatten().to_numpy()
    return out


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def angles(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to each reference (a right angle for a zero vector)."""
    width = max(x.shape[1], refs.shape[1])
    f = _fit(x.astype(np.float64), width)
    norm = np.sqrt(np.einsum("ij,ij->i", f, f))
    cos = f @ _fit(refs, width).T / np.where(norm > 0, norm, 1.0)[:, None]
    return norm, np.arccos(np.clip(cos, -1, 1))


def references(index: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit directions far from each other, among the ``sample`` distinct rows of
    least hash: each next one is the row whose nearest reference is farthest."""
    rows = index.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(sample).select("v").toArrow()
    x = _matrix(rows.column("v")).astype(np.float64) if rows.num_rows else np.zeros((0, 0))
    norm = np.sqrt((x * x).sum(1))
    x = x[norm > 0] / norm[norm > 0][:, None]
    if not len(x):
        return np.zeros((0, 0))
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(count, len(x)):
        nxt = int(near.argmin())
        if near[nxt] > 1 - 1e-9:
            break
        picked.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    return x[picked]


def _sort_key(refs):
    """label, nearest reference and angle to it: what the index is ordered by."""
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            norm, angle = angles(x, refs.value) if len(refs.value) else (np.zeros(len(x)), np.zeros((len(x), 1)))
            ref = angle.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ref.astype(np.int32)), pa.array(angle[np.arange(len(x)), ref])],
                                             names=[*batch.schema.names, "ref", "angle"])
    return run


def _pack(refs, size):
    """Blocks of rows of one label, each one row of the index: numbers, ids,
    norms and angles as bytes."""
    def pack(table):
        x = _matrix(table.column("v"))
        norm, angle = angles(x, refs.value) if len(refs.value) else (np.sqrt((x.astype(np.float64) ** 2).sum(1)), np.zeros((len(x), 0)))
        ids = table.column("ids").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.array([int(table.column("label")[0].as_py())], pa.int64()), pa.array([len(x)], pa.int32()),
             pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()),
             pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int64).tobytes()], pa.binary()),
             pa.array([norm.tobytes()], pa.binary()), pa.array([angle.astype(np.float32).tobytes()], pa.binary())],
            names=["label", "rows", "v", "ids", "n_ids", "norm", "angle"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows:
                label = held.column("label").to_numpy()
                same = int(np.searchsorted(label, label[0], "right"))
                if same < size and same == held.num_rows:
                    break  # the label may go on
                yield pack(held.slice(0, min(size, same)))
                held = held.slice(min(size, same))
        if held is not None and held.num_rows:
            yield pack(held)
    return run


INDEX = "label long, rows int, v binary, ids binary, n_ids binary, norm binary, angle binary"


def build_index(rows: DataFrame, refs, keep: int) -> DataFrame:
    """The packed index in the shared folder: one row per distinct (label, v)
    with its ``keep`` smallest ids."""
    spark = rows.sparkSession
    one = rows.groupBy("label", "v", "id").agg(F.lit(1).alias("__1"))
    rank = Window.partitionBy("label", "v").orderBy("id")
    few = one.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= keep)
    classes = few.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    keyed = C.write_read(classes.mapInArrow(_sort_key(refs), "label long, v array<long>, ids array<long>, ref int, angle double"), "vectors")
    dealt = keyed.repartitionByRange(C.partitions(spark), "label", "ref", "angle", "v").sortWithinPartitions("label", "ref", "angle", "v")
    return C.write_read(dealt.select("label", "v", "ids").mapInArrow(_pack(refs, BLOCK), INDEX), "index")


class Block:
    """One row of the index, unpacked, with the bounds of its windows."""

    def __init__(self, row, references: int):
        n = row["rows"]
        self.label = row["label"]
        self.x = np.frombuffer(row["v"], np.int64).reshape(n, -1)
        self.count = np.frombuffer(row["n_ids"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.ids = np.frombuffer(row["ids"], np.int64)
        norm = np.frombuffer(row["norm"], np.float64)
        angle = np.frombuffer(row["angle"], np.float32).reshape(n, references).astype(np.float64)
        self.at = np.arange(0, n, WINDOW)
        self.norm = np.minimum.reduceat(norm, self.at), np.maximum.reduceat(norm, self.at)
        self.angle = np.minimum.reduceat(angle, self.at, axis=0), np.maximum.reduceat(angle, self.at, axis=0)
        self.end = np.append(self.at[1:], n)

    def bounds(self, norm: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each anchor (row) with any row of
        each window (column)."""
        low = np.zeros((len(norm), len(self.at)))
        high = np.full(low.shape, np.pi)
        for r in range(angle.shape[1]):
            p, q0, q1 = angle[:, r, None], self.angle[0][None, :, r], self.angle[1][None, :, r]
            low = np.maximum(low, np.maximum(q0 - p, p - q1))
            # p + q grows and 2 pi - p - q falls with q: their lesser is greatest where they meet, at pi
            high = np.minimum(high, np.where(p + q1 <= np.pi, p + q1, np.where(p + q0 >= np.pi, 2 * np.pi - p - q0, np.pi)))
        most, least = np.cos(low) + SLACK, np.cos(high) - SLACK
        small, large = norm[:, None] * self.norm[0][None, :], norm[:, None] * self.norm[1][None, :]
        return np.floor(np.where(least < 0, least * large, least * small)) - 1, np.ceil(np.where(most > 0, most * large, most * small)) + 1

    def scores(self, x: np.ndarray, window: int) -> np.ndarray:
        return products(x, self.x[self.at[window]:self.end[window]])

    def named(self, hit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For rows of a window: which of ``hit`` each id belongs to, and the ids."""
        rows = hit + self.at[window]
        owner = np.repeat(np.arange(len(rows)), self.count[rows])
        total = np.cumsum(self.count[rows])
        place = np.arange(len(owner)) - np.repeat(total - self.count[rows], self.count[rows]) + np.repeat(self.first[rows], self.count[rows])
        return owner, self.ids[place]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers (by the floating-point unit where
    no sum can reach 2**53)."""
    width = max(x.shape[1], y.shape[1])
    x, y = _fit(x, width), _fit(y, width)
    if not width:
        return np.zeros((len(x), len(y)), np.int64)
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * width
    if most < 2 ** 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


class Best:
    """The best (score, smaller id first) of a number of searches, at most ``k``
    each."""

    def __init__(self, searches: int, k: int):
        self.k = k
        self.score = np.full((searches, k), NONE, np.int64)
        self.ids = np.full((searches, k), np.iinfo(np.int64).max, np.int64)

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(search):
            return
        touched = np.unique(search)
        s = np.concatenate([np.repeat(touched, self.k), search])
        v = np.concatenate([self.score[touched].ravel(), score])
        i = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((i, ~v, s))  # ~v falls as v grows, without overflow
        s, v, i = s[order], v[order], i[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (v[1:] != v[:-1]) | (i[1:] != i[:-1])])  # a result counts once
        new |= v == NONE
        s, v, i = s[new], v[new], i[new]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        rank = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
        top = rank < self.k
        self.score[s[top], rank[top]] = v[top]
        self.ids[s[top], rank[top]] = i[top]

    def rows(self):
        search, place = np.nonzero(self.score != NONE)
        return search, self.score[search, place], self.ids[search, place]


class Anchors:
    """A block of anchors as arrays."""

    def __init__(self, table: pa.Table, refs: np.ndarray):
        self.key = table.column("key").to_numpy()
        self.ids = table.column("id").to_numpy()
        self.label = table.column("label").to_numpy()
        self.x = _matrix(table.column("v"))
        self.norm, self.angle = angles(self.x, refs) if len(refs) else (np.sqrt((self.x.astype(np.float64) ** 2).sum(1)), np.zeros((len(self.x), 0)))


def _blocks(batches, references: int):
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row, references)


def _positives(shared, references: int, k: int):
    def run(batches):
        a: Anchors = shared.value
        best, seen, scored = Best(len(a.key), k), 0, 0
        for block in _blocks(batches, references):
            mine = np.flatnonzero(a.label == block.label)
            if not len(mine):
                continue
            _, most = block.bounds(a.norm[mine], a.angle[mine])
            seen += most.size
            for w in range(len(block.at)):
                look = mine[most[:, w] >= best.least[mine]]
                scored += len(look)
                if not len(look):
                    continue
                s = block.scores(a.x[look], w)
                at, hit = np.nonzero(s >= best.least[look][:, None])
                owner, ids = block.named(hit, w)
                search, score = look[at][owner], s[at, hit][owner]
                other = ids != a.ids[search]
                best.add(search[other], score[other], ids[other])
        search, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(a.key[search]), pa.array(score), pa.array(ids)], names=["key", "score", "id"])
        yield _count(seen, scored)
    return run


def _negatives(shared, references: int, k: int):
    def run(batches):
        a, who, low, high = shared.value  # searches: anchor index, least and greatest score
        best, seen, scored = Best(len(who), k), 0, 0
        for block in _blocks(batches, references):
            mine = np.flatnonzero(a.label[who] != block.label)
            if not len(mine):
                continue
            anchors, back = np.unique(who[mine], return_inverse=True)
            least, most = block.bounds(a.norm[anchors], a.angle[anchors])
            seen += most.size
            for w in range(len(block.at)):
                floor = np.maximum(low[mine], best.least[mine])
                over = (most[back, w] >= floor) & (least[back, w] <= high[mine])
                if not over.any():
                    continue
                look, place = np.unique(back[over], return_inverse=True)
                scored += len(look)
                s = block.scores(a.x[anchors[look]], w)[place]
                mark = (s >= floor[over][:, None]) & (s <= high[mine[over]][:, None])
                at, hit = np.nonzero(mark)
                owner, ids = block.named(hit, w)
                search, score = mine[over][at][owner], s[at, hit][owner]
                other = ids != a.ids[who[search]]
                best.add(search[other], score[other], ids[other])
        search, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(search), pa.array(score), pa.array(ids)], names=["key", "score", "id"])
        yield _count(seen, scored)
    return run


def _count(seen: int, scored: int) -> pa.RecordBatch:
    """Two rows without a key: windows met and windows scored by a task."""
    return pa.RecordBatch.from_arrays([pa.array([None, None], pa.int64()), pa.array([seen, scored], pa.int64()), pa.array([0, 1], pa.int64())], names=["key", "score", "id"])


def _told(found: DataFrame, block: int, name: str) -> list:
    """One row of the filtering report."""
    got = found.where("key is null").groupBy().agg(F.sum(F.when(F.col("id") == 0, F.col("score"))), F.sum(F.when(F.col("id") == 1, F.col("score")))).first()
    return [block, name, got[0] or 0, got[1] or 0]


def _ranges(anchors: DataFrame, most: int) -> list[list[int]]:
    """First and last key of blocks of at most ``most`` anchors; keys count up
    from partition << 33 in each partition."""
    part = F.shiftright("key", 33).alias("part")
    out, held = [], 0
    for row in anchors.groupBy(part).agg(F.count("*").alias("n")).orderBy("part").toLocalIterator():
        at = 0
        while at < row.n:
            take = min(row.n - at, most - held)
            begin = (row.part << 33) + at
            if held:
                out[-1][1] = begin + take - 1
            else:
                out.append([begin, begin + take - 1])
            at += take
            held = (held + take) % most
    return out


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The best k of each search over all tasks, with their rank."""
    rank = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    return found.where("key is not null").distinct().withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> tuple[DataFrame, DataFrame]:
    """(mined, filtering). ``mined``: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score; the negatives of a positive of score p have
    low * p <= 100 * score <= high * p. ``filtering``: per pass and block of anchors,
    how many (anchor, window) pairs there were and how many were scored."""
    spark = rows.sparkSession
    kept = whole_vectors(rows, is_anchor, id_col, vector_col, label_col, scale)
    refs = references(kept)
    shared_refs = spark.sparkContext.broadcast(refs)
    # a row's own id is left out, so a class names one id more than a search returns
    index = build_index(kept, shared_refs, max(positives, negatives) + 1)
    few = kept.where("anchor").groupBy("id", "label", "v").agg(F.lit(1).alias("__1")).drop("__1")
    keyed = few.mapInArrow(_sort_key(shared_refs), "id long, label long, v array<long>, ref int, angle double")
    dealt = C.write_read(keyed, "anchors").repartitionByRange(C.partitions(spark), "label", "ref", "angle", "id", "v").sortWithinPartitions("label", "ref", "angle", "id", "v")
    # numbered in this order, so a block holds anchors of like labels and angles
    anchors = C.write_read(dealt.select("id", "label", "v", F.monotonically_increasing_id().alias("key")), "anchors")
    starts = _ranges(anchors, ANCHORS)
    stats = []
    folder = C.scratch_path(spark, "mined")
    for number, (begin, end) in enumerate(starts):
        block = anchors.where((F.col("key") >= begin) & (F.col("key") <= end)).orderBy("key").toArrow()
        a = Anchors(block, refs)
        cast = spark.sparkContext.broadcast(a)
        found = C.write_read(index.where(F.col("label").isin([int(x) for x in np.unique(a.label)])).mapInArrow(_positives(cast, len(refs), positives), "key long, score long, id long"), "found")
        stats.append(_told(found, number, "positives"))
        pos = _merge(found, positives).orderBy("key", "rank").toArrow()  # at most ``positives`` rows per anchor of this block
        key, score = pos.column("key").to_numpy(), pos.column("score").to_numpy()
        who = np.searchsorted(a.key, key)
        # -(-x // 100) rounds up; an empty window (a negative score) finds nothing
        least, most = -(-low * score // 100), high * score // 100
        open_ = least <= most
        searches = spark.sparkContext.broadcast((a, who[open_], least[open_], most[open_]))
        found = C.write_read(index.mapInArrow(_negatives(searches, len(refs), negatives), "key long, score long, id long"), "found")
        stats.append(_told(found, number, "negatives"))
        names = pa.table({"key": pa.array(np.arange(int(open_.sum()))), "anchor_id": pa.array(a.ids[who[open_]]),
                          "positive_id": pos.column("id").to_numpy()[open_], "positive_score": score[open_]})
        part = _merge(found, negatives).join(F.broadcast(spark.createDataFrame(names)), "key")  # at most ANCHORS * positives rows
        part.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
        cast.unpersist()
        searches.unpersist()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    mined = spark.read.schema(schema).parquet(folder) if starts else spark.createDataFrame([], schema)
    told = "block int, pass string, windows long, scored long"
    if not stats:
        return mined, spark.createDataFrame([], told)
    return mined, spark.createDataFrame([tuple(x) for x in stats], told)
