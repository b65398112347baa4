"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Each text becomes its set of distinct word shingles (hashed to 64 bits), a
   signature of 64 minima and a 128-bit digest of the set. Texts with one set
   are one class, so exact copies never meet each other again.
2. The forest holds several orders of the signature's values. A region is the
   classes that agree on the first values of an order, as many as its depth.
   Regions of one class end here.
3. The depth adapts to the region. All begin with depth 3 in 16 orders. The
   classes of a region of more than ``BLOCK`` classes go down to depth 6, where
   96 orders make up for the deeper prefix, and from there to depth 9 in 512
   orders. Before each step, the crowded classes are sorted by their signatures
   in several orders, and neighbours by longest common prefix that look alike
   are joined; a deeper region whose classes are all joined by then ends. What
   is crowded at the last depth is dealt out: the largest joined group of a
   region, in blocks, meets the blocks of the rest, and these each other.
4. Inside a region, classes are sorted by the signature in the region's order.
   Neighbours by longest common prefix that look alike form runs. All classes
   outside the largest run are then compared with all classes, run by run. The
   region proposes the neighbours and one pair for each two runs of a spanning
   forest: never all its pairs.
5. The proposals' components are the neighbourhoods: whatever links there are
   lie inside them. Each class sends its full shingle set to its neighbourhood
   once, and all intersections there are counted exactly. A neighbourhood of
   more than ``BLOCK`` classes is first cut into blocks that share some of its
   classes; the group that comes out largest then meets the rest in blocks, so
   that a task never holds more than about ``BLOCK`` sets. Each task returns a
   spanning forest of the true links.
6. The components of these links are the result.

Two classes look alike if their signatures agree on at least ``_least(percent)``
values: 36 of 64 for 85 percent, 34 for 80. ``_missed`` gives the odds that a
pair shares no region of a depth; the README states them.

Defined cases: null or wordless texts have an empty set and link with nothing;
fewer than ``words`` words are one shingle; rows that share an id get a result
each and are one node of the graph (with the set of the smallest digest); a
row with a null id takes the component of its class, null if it has none.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

VALUES, ORDERS, DEPTH = 64, 16, 3
STEP = VALUES // ORDERS
#: (depth, orders) of the regions and of those that crowded regions go down to.
LEVELS = ((DEPTH, ORDERS), (6, 96), (9, 512))
#: Orders in which crowded classes are sorted, and values of a sort key.
SORTED, KEY = 16, 16
#: Classes that all blocks of a large neighbourhood share, about.
ANCHORS = 64
#: Classes that are compared at once.
BLOCK = 4096

_rng = np.random.default_rng(99)
MUL = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
SPACE = np.ones(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def shingles(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row (A-Z lower-cased, words are
    runs of anything but space and U+0009 to U+000D)."""
    low = C.LOWER[data]
    start, end, row = C.word_spans(low, off, SPACE)
    wh = C.span_hash(C.prefix_hash(low), start, end)
    wh = C.mix(wh + (end - start).astype(np.uint64))
    first = np.searchsorted(row, np.arange(len(off)))
    n = len(wh)
    h = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        h += C.mix(wh[k:k + len(h)] * np.uint64(2 * k + 1) + np.uint64(k * 0x51ED27))
    h = C.mix(h)
    out = []
    for i in range(len(off) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            out.append(np.unique(h[a:b - words + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = C.mix(short * np.uint64(31) + wh[k:k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES minima of 32 bits each."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        x = s[at:at + 4096]
        h = x[None, :] * MUL[:, None] + ADD[:, None]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9FB21C651E98DF25)
        low = np.minimum(low, h.min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _profile(words: int):
    schema = pa.schema([("__id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__text"):
            sets = shingles(data, off, words)
            yield pa.RecordBatch.from_arrays([
                rows.column("__id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], schema=schema)
    return run


def _orders(level: int) -> np.ndarray:
    """The orders of a level, a row each: rotations of the signature at first,
    permutations from a fixed seed below."""
    if level == 0:
        return (np.arange(ORDERS)[:, None] * STEP + np.arange(VALUES)) % VALUES
    rng = np.random.default_rng(1000 + level)
    return np.array([rng.permutation(VALUES) for _ in range(LEVELS[level][1])])


def _signatures(column) -> np.ndarray:
    data, _ = C.string_view(column)
    return np.ascontiguousarray(data).view(np.uint32).reshape(-1, VALUES)


def _regions(level: int):
    """(region, order, class) for each order of a level of the forest."""
    orders, depth = _orders(level), LEVELS[level][0]

    def run(batches):
        for b in batches:
            sig = _signatures(b.column("sig")).astype(np.uint64)
            for t, order in enumerate(orders):
                h = np.full(len(sig), t + 1 + 1000 * level, np.uint64)
                for k in range(depth):
                    h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, order[k]])
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(h)), pa.array(np.full(len(sig), t, np.int32)), b.column("cls")], names=["region", "ord", "cls"])
    return run


def _sort_keys(level: int):
    """Classes with the beginning of their signature in each of SORTED orders."""
    orders = _orders(level)[:SORTED]

    def run(batches):
        for b in batches:
            sig = _signatures(b.column("sig"))
            for t, order in enumerate(orders):
                keys = np.ascontiguousarray(sig[:, order[:KEY]].astype(">u4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), b.column("cls"), b.column("sig")],
                                                 names=["ord", "key", "cls", "sig"])
    return run


def _adjacent(least: int):
    """Neighbours of a sorted order that look alike."""
    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, sig = np.asarray(b.column("cls")), _signatures(b.column("sig"))
            if last is not None:
                ids, sig = np.append(last[0], ids), np.concatenate([last[1], sig])
            last = ids[-1:], sig[-1:]
            at = np.flatnonzero(((sig[1:] == sig[:-1]).sum(axis=1) >= least) & (ids[1:] != ids[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[at], ids[at + 1])), pa.array(np.maximum(ids[at], ids[at + 1]))], schema=PAIR)
    return run


def _grouped(batches, column: str):
    """Tables of whole groups of rows sorted by ``column`` (many small groups
    at once)."""
    held, count = [], 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        count += b.num_rows
        if count < 1024:
            continue
        t = pa.concat_tables(held)
        k = np.asarray(t.column(column))
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        held, count = [t], len(t)
    if count:
        yield pa.concat_tables(held)


def _cuts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n, out = len(linked), []
    fresh = np.ones(n, bool)
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        queue = [root]
        while queue and fresh.any():
            i = queue.pop()
            new = np.flatnonzero(linked[i] & fresh)
            fresh[new] = False
            out.extend((i, int(j)) for j in new)
            queue.extend(new.tolist())
    return out


def _runs(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs of rows that join all signatures of a region that look alike, over
    others where need be. The rows come sorted, so that neighbours have the
    longest common prefixes."""
    n = len(sig)
    near = (sig[1:] == sig[:-1]).sum(axis=1) >= least
    out = [(int(i), int(i) + 1) for i in np.flatnonzero(near)]
    if near.all():
        return out
    first = np.flatnonzero(np.concatenate([[True], ~near]))
    run = np.concatenate([[0], np.cumsum(~near)])
    rest = np.flatnonzero(run != np.diff(np.append(first, n)).argmax())
    met = np.zeros((len(first), len(first)), bool)
    step = max(1, (1 << 18) // n)
    for at in range(0, len(rest), step):
        mine = rest[at:at + step]
        same = np.zeros((len(mine), n), np.uint8)
        for k in range(VALUES):
            same += sig[mine, k, None] == sig[None, :, k]
        by_run = np.logical_or.reduceat(same >= least, first, axis=1)
        start = np.flatnonzero(np.concatenate([[True], run[mine[1:]] != run[mine[:-1]]]))
        met[run[mine[start]]] |= np.logical_or.reduceat(by_run, start, axis=0)
    met |= met.T
    np.fill_diagonal(met, False)
    return out + [(int(first[i]), int(first[j])) for i, j in _forest(met)]


def _below(m: int, p: float) -> float:
    """Odds that fewer than ``m`` of VALUES minima agree at likeness ``p``."""
    return sum(math.comb(VALUES, k) * p ** k * (1 - p) ** (VALUES - k) for k in range(m))


def _least(percent: int) -> int:
    """The most agreeing values to ask for that lose a pair at the threshold
    with less than a tenth of the odds of its sharing no region."""
    p = percent / 100
    return max(m for m in range(VALUES + 1) if _below(m, p) <= 0.1 * (1 - p ** DEPTH) ** ORDERS)


def _missed(level: int, p: float) -> float:
    """Odds that a pair of likeness ``p`` shares no region of a level. Orders of
    the first level have no value of their regions in common; those below are
    permutations, which share a region with C(m, depth) / C(VALUES, depth) if m
    values agree."""
    depth, orders = LEVELS[level]
    if level == 0:
        return (1 - p ** depth) ** orders
    return sum(math.comb(VALUES, m) * p ** m * (1 - p) ** (VALUES - m) * (1 - math.comb(m, depth) / math.comb(VALUES, depth)) ** orders for m in range(VALUES + 1))


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS = "a long, b long"


def _pair_batch(pairs: set) -> pa.RecordBatch:
    rows = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=PAIR)


def _propose(least: int, level: int | None = None):
    """Proposals of whole regions; their rows are sorted by the region's order
    here if its ``level`` is given."""
    def run(batches):
        orders = None if level is None else _orders(level)[:, LEVELS[level][0]:][:, :KEY]
        for t in _grouped(batches, "task"):
            task, ids, sig = np.asarray(t.column("task")), np.asarray(t.column("cls")), _signatures(t.column("sig"))
            order = None if level is None else np.asarray(t.column("ord"))
            cuts, out = _cuts(task), set()
            for a, b in zip(cuts[:-1], cuts[1:]):
                mine, s = ids[a:b], sig[a:b]
                if b - a > 2 and order is not None:
                    sort = np.lexsort(s[:, orders[order[a]][::-1]].T)
                    mine, s = mine[sort], s[sort]
                out.update((min(x, y), max(x, y)) for x, y in ((int(mine[i]), int(mine[j])) for i, j in _runs(s, least)) if x != y)
            if out:
                yield _pair_batch(out)
    return run


def _links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets are linked: exact intersection counts of all pairs."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    if n <= 32:
        both = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        row = np.repeat(np.arange(n), size)
        _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[col] > 1  # a shingle of one set is in no intersection
        row, col = row[shared], col[shared]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((n, n), np.float32)
        first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]])) if len(col) else np.zeros(0, np.int64)
        nth = np.cumsum(np.concatenate([[0], col[1:] != col[:-1]])) if len(col) else np.zeros(0, np.int64)
        first = np.append(first, len(col))
        for at in range(0, len(first) - 1, 2048):
            a, b = first[at], first[min(at + 2048, len(first) - 1)]
            part = np.zeros((n, 2048), np.float32)
            part[row[a:b], nth[a:b] - at] = 1
            both += part @ part.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    return linked


def _confirm(percent: int):
    def run(batches):
        for t in _grouped(batches, "task"):
            task, ids = np.asarray(t.column("task")), np.asarray(t.column("cls"))
            data, off = C.string_view(t.column("shingles"))
            cuts, out = _cuts(task), set()
            for a, b in zip(cuts[:-1], cuts[1:]):
                sets = [np.frombuffer(data[off[i]:off[i + 1]].tobytes(), np.uint64) for i in range(a, b)]
                out.update((min(x, y), max(x, y)) for x, y in ((int(ids[a + i]), int(ids[a + j])) for i, j in _forest(_links(sets, percent))) if x != y)
            if out:
                yield _pair_batch(out)
    return run


def _sets(words: int):
    schema = pa.schema([("cls", pa.int64()), ("comp", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__text"):
            sets = shingles(data, off, words)
            yield pa.RecordBatch.from_arrays([
                rows.column("cls"), rows.column("comp"), rows.column("size"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) with comp the smallest node that each node of ``edges``
    (a, b) reaches. Alternates joining neighbours to the smallest neighbour of
    each node, on both sides, until every node points at its smallest."""
    e = C.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        nxt = C.cut(nxt)
        # done when the edges are stars: no node has two smaller ones, none is both end and centre
        multi = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        chain = nxt.select("v").distinct().join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        e = nxt
        if not multi.unionByName(chain.select(F.col("v").alias("u"), F.lit(1).cast("long").alias("n"))).take(1):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id (smallest
    id reachable over links, itself included) and kept (id = component_id).
    Links join sets with 100 * intersection >= percent * union."""
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    prof = C.write_read(base.mapInArrow(_profile(words), "__id long, n_shingles long, digest binary, sig binary"), "profiles")
    # a class is named by the smallest id of its rows
    classes = C.write_read(prof.where("digest is not null and __id is not null").groupBy("digest").agg(F.min("__id").alias("cls"), F.first("sig").alias("sig")), "classes")

    nodes = classes.groupBy("cls").agg(F.min_by("sig", "digest").alias("sig"))
    near = C.cut(components(_neighbourhoods(nodes, _least(percent))))
    comp = C.cut(components(_linked(base, near, words, percent)))

    named = classes.select("digest", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("digest", F.coalesce("comp", "cls").alias("__comp"))
    out = prof.select("__id", "n_shingles", "digest").join(named, "digest", "left")
    comp_id = F.coalesce("__comp", "__id")
    return out.select(F.col("__id").alias(id_col), "n_shingles", comp_id.alias("component_id"), F.col("__id").eqNullSafe(comp_id).alias("kept"))


def _neighbourhoods(nodes: DataFrame, least: int) -> DataFrame:
    """Proposals (a, b) of all regions of the forest over ``nodes`` (cls, sig)."""
    n = C.partitions(nodes.sparkSession)
    crowd, proposed, joined = nodes, None, None
    for level in range(len(LEVELS)):
        member = crowd.mapInArrow(_regions(level), "region long, ord int, cls long")
        if joined is None:
            member = member.withColumn("comp", F.col("cls"))
        else:
            member = member.join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        # a region whose classes are all joined has nothing left to propose
        sizes = member.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        sizes = C.cut(sizes.where("low < high").select("region", "size"))
        crowded = sizes.where(F.col("size") > BLOCK)
        tasks = member.join(sizes.where(F.col("size") <= BLOCK), "region").select(F.col("region").alias("task"), "ord", "cls")
        deeper = crowded.take(1)
        if deeper and level + 1 == len(LEVELS):
            tasks = tasks.unionByName(_deal(_cored(member.join(crowded, "region"), "region"), "region").select("task", "ord", "cls"))
        pairs = tasks.join(nodes, "cls").repartition(n, "task").sortWithinPartitions("task").mapInArrow(_propose(least, level), PAIRS).distinct()
        proposed = pairs if proposed is None else proposed.unionByName(pairs)
        if not deeper or level + 1 == len(LEVELS):
            return proposed
        crowd = C.cut(member.join(crowded, "region", "left_semi").select("cls").distinct().join(nodes, "cls"))
        keys = crowd.mapInArrow(_sort_keys(level + 1), "ord int, key binary, cls long, sig binary")
        alike = keys.repartitionByRange(n, "ord", "key").sortWithinPartitions("ord", "key").mapInArrow(_adjacent(least), PAIRS)
        proposed = C.cut(proposed.unionByName(alike.distinct()))
        joined = C.cut(components(proposed))


def _cored(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (cls, comp and the size of the group) with ``core``, whether the
    class is in the largest comp of its group, and that comp's size ``n_core``."""
    comps = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("n"))
    core = comps.groupBy(group).agg(F.max(F.struct("n", "comp")).alias("top")).select(group, F.col("top.n").alias("n_core"), F.col("top.comp").alias("__core"))
    return rows.join(core, group).withColumn("core", F.col("comp") == F.col("__core")).drop("__core")


def _deal(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (cls and the size of its group) by task. A group of at most
    ``BLOCK`` classes is one task; a larger one has a task for each pair of its
    sub-blocks, so that any two of its classes share one. With a joined core
    (see ``_cored``), tasks pair a block of the rest with one of the core or of
    the rest: the rows grow with the core times the blocks of the rest."""
    half = BLOCK // 2
    if "core" not in rows.columns:
        rows = rows.withColumn("core", F.lit(False)).withColumn("n_core", F.lit(0))
    rows = rows.withColumn("cores", F.ceil(F.col("n_core") / half).cast("int")).withColumn("rests", F.ceil((F.col("size") - F.col("n_core")) / half).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.hash("cls"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests"))))
    each = lambda count: F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
    with_core = F.transform(each("cores"), lambda i: F.xxhash64(group, F.lit("core"), i, "mine"))
    among = F.transform(F.filter(each("rests"), lambda j: (j != F.col("mine")) | ((F.col("rests") == 1) & (F.col("cores") == 0))),
                        lambda j: F.xxhash64(group, F.least("mine", j), F.greatest("mine", j)))
    tasks = F.when(F.col("size") <= BLOCK, F.array(F.xxhash64(group)))
    tasks = tasks.when(F.col("core"), F.transform(each("rests"), lambda j: F.xxhash64(group, F.lit("core"), "mine", j)))
    return rows.withColumn("task", F.explode(tasks.otherwise(F.concat(with_core, among))))


def _linked(base: DataFrame, near: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the links inside the neighbourhoods ``near``
    (node, comp)."""
    size = C.cut(near.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))
    near = near.select(F.col("node").alias("cls"), "comp").join(size, "comp")
    out = _confirmed(_shingled(base, near.where(F.col("size") <= BLOCK), words).withColumn("task", F.xxhash64("comp")), percent)
    if not size.where(F.col("size") > BLOCK).take(1):
        return out
    large = C.write_read(_shingled(base, near.where(F.col("size") > BLOCK), words), "neighbourhoods")
    # blocks of a neighbourhood that share some classes find most of its links
    blocks = F.ceil(F.col("size") / max(1, BLOCK // 2)).cast("int")
    shared = F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.floor(F.col("size") / min(ANCHORS, max(1, BLOCK // 2))))) == 0
    block = F.when(shared, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.hash("cls"), blocks)))
    links = C.cut(_confirmed(large.withColumn("block", F.explode(block)).withColumn("task", F.xxhash64("comp", "block")), percent))
    # the largest group that they make meets the rest
    group = components(links).select(F.col("node").alias("cls"), F.col("comp").alias("found"))
    rows = large.select("cls", F.col("comp").alias("group"), "size").join(group, "cls", "left").withColumn("comp", F.coalesce("found", "cls")).drop("found")
    rows = _deal(_cored(rows, "group"), "group").select("task", "cls").join(large.select("cls", "shingles"), "cls")
    return out.unionByName(links).unionByName(_confirmed(rows, percent))


def _shingled(base: DataFrame, near: DataFrame, words: int) -> DataFrame:
    """``near`` (cls, comp, size) with the shingle sets of the classes."""
    # the texts are dealt by id on purpose: a broadcast of the ids would grow with the corpus
    texts = base.join(near.hint("merge"), F.col("__id") == F.col("cls")).select("cls", "comp", "size", "__text")
    sets = texts.mapInArrow(_sets(words), "cls long, comp long, size long, digest binary, shingles binary")
    return sets.groupBy("cls", "comp", "size").agg(F.min_by("shingles", "digest").alias("shingles"))


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """Spanning forests of the links inside each task."""
    rows = rows.select("task", "cls", "shingles").repartition(C.partitions(rows.sparkSession), "task").sortWithinPartitions("task")
    return rows.mapInArrow(_confirm(percent), PAIRS).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose id names their component, all columns as they
    are; of rows that share an id, one stays (the smallest text)."""
    gone = near_duplicates(docs, id_col, text_col, words, percent).where(~F.col("kept")).select(F.col(id_col).alias("__gone"))
    out = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(id_col).alias("__again"))
    if again.take(1):
        twice = out.join(again, F.col(id_col) == F.col("__again"), "left_semi")
        one = twice.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(text_col)).alias("__row")).select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
        out = out.join(again, F.col(id_col) == F.col("__again"), "left_anti").unionByName(one)
    return out
