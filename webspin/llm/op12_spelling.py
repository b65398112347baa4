"""Spelling variants: words at one edit from each other, by dynamic programming
over sorted lists.

Words are counted over whole texts. Two words at one edit share everything but
one third of the shorter word, so every word goes to the groups named by the
rest of it: three for its own length as the shorter length, three for one
less. A group is a sorted list. Each of its words scans the list forward from
its own place. The rows of the banded edit matrix (three cells) up to the
longest common prefix (LCP) with the word before are kept, so only new letters
make new rows; where a row has no cell of at most one edit, all words that
share the prefix read so far are skipped. Many scans advance together as numpy
arrays.

A pair is taken only in the group whose third holds its first difference, so it
counts once without a shuffle. A group of more than ``LIMIT`` words is dealt
out again by the single place of the difference; such a group holds at most
one word per letter and two letters (90 + 90 * 90), whatever the input.

Defined cases: null and empty texts have no words; a null id counts as an empty
string in the deletion rule; rows that repeat an id count like any others; ties
of equal counts go to the smaller word; a word of any length is kept whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

#: Words of a group before it is dealt out by single places.
LIMIT = 4096
#: Distinct words that a counting task holds before it passes them on.
HELD = 300_000
#: Rows of whole groups that are scanned together, and cells of their matrices.
ROWS, CELLS = 30_000, 12_000_000
#: Bytes of a text that are cut into words at a time.
PIECE = 4 << 20
PARTS = 3
RUN = re.compile("[a-zÀ-ÿ]+")
NOT_LETTER = re.compile("[^a-zÀ-ÿ]")


def _runs(text: str):
    """Lists of the lower-cased runs of a text, piece by piece."""
    low = text.encode("utf-8", "replace").lower().decode()  # bytes.lower() changes A-Z only
    at = 0
    while at < len(low):
        end = NOT_LETTER.search(low, min(len(low), at + PIECE))
        to = end.start() if end else len(low)
        yield RUN.findall(low, at, to)
        at = to


def _count(modulus: int, least: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flush(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                own: Counter = Counter()
                for words in _runs(text):
                    own.update(words)
                start = zlib.crc32(f"{ids[i].as_py() or ''}:".encode())
                for w, k in own.items():
                    h = zlib.crc32(w.encode(), start)
                    if not h % modulus:
                        p = h % len(w)
                        w = w[:p] + w[p + 1:]
                    if len(w) >= least:
                        held[w] = held.get(w, 0) + k
                if len(held) >= HELD:
                    yield flush(held)
                    held = {}
        yield flush(held)
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3,
                modulus: int = 97) -> DataFrame:
    """(word, n): the words of at least ``least_letters`` code points that occur
    ``least_count`` times or more in all texts, after the deletion rule."""
    base = docs.select(F.col(id_col).cast("string").alias("__i"), F.col(text_col).alias("__t"))
    return base.mapInArrow(_count(modulus, least_letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _key(word: Column, size: Column, m: Column, a: Column, b: Column) -> Column:
    """Hash of what stays of a word when places [a, b) of the shorter length m
    are left out (one place more in a word of m + 1)."""
    rest = b + (size - m)
    return F.xxhash64(m, a, b, F.substring(word, F.lit(1), a), F.substring(word, rest + 1, size))


def _thirds(words: DataFrame, least: int) -> DataFrame:
    size = F.char_length("word")
    spans = []
    for less in (0, 1):
        m = size - less
        spans += [F.struct(m.alias("m"), F.floor(m * k / PARTS).cast("int").alias("a"), F.floor(m * (k + 1) / PARTS).cast("int").alias("b")) for k in range(PARTS)]
    rows = words.select("word", "n", F.explode(F.array(*spans)).alias("s")).select("word", "n", "s.m", "s.a", "s.b").where((F.col("m") >= least) & (F.col("m") >= 1))
    return rows.withColumn("key", _key(F.col("word"), size, F.col("m"), F.col("a"), F.col("b")))


def _places(rows: DataFrame) -> DataFrame:
    """Rows of crowded groups, dealt out by each single place of their third."""
    size = F.char_length("word")
    out = rows.where("b > a").select("word", "n", "m", F.explode(F.sequence("a", F.col("b") - 1)).alias("a")).withColumn("b", F.col("a") + 1)
    return out.withColumn("key", _key(F.col("word"), size, F.col("m"), F.col("a"), F.col("b")))


def _adjacent_lcp(chars, start, size, group) -> np.ndarray:
    """LCP of each word with the one before it in its group (0 at a border)."""
    n = len(size)
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(group[1:] == group[:-1]) + 1
    longest = np.minimum(size[live], size[live - 1])
    for i in live[longest > 512]:  # long words one by one, by whole arrays
        k = min(size[i], size[i - 1])
        differ = chars[start[i]:start[i] + k] != chars[start[i - 1]:start[i - 1] + k]
        lcp[i] = differ.argmax() if differ.any() else k
    live, longest = live[longest <= 512], longest[longest <= 512]
    at = 0
    while len(live):
        go = at < longest
        live, longest = live[go], longest[go]
        same = chars[start[live] + at] == chars[start[live - 1] + at]
        live, longest = live[same], longest[same]
        at += 1
        lcp[live] = at
    return lcp


def scan(chars, start, size, lcp, query, last):
    """All (query, later word, common prefix) of one edit, among the words after
    each query up to ``last``. Rows of the matrix are kept on one stack per query:
    row j compares the first j letters of the list's word with the first
    j - 1, j and j + 1 letters of the query."""
    found = []
    longest = int(size[query].max()) + 2
    stack = np.full((len(query), longest + 1, 3), 3, np.uint8)
    depth = np.arange(longest + 1)
    # the rows of a word against itself are known
    inside = depth[None, :] <= size[query][:, None]
    stack[:, :, 1][inside] = 0
    stack[:, 1:, 0][inside[:, 1:]] = 1
    stack[:, :-1, 2][inside[:, 1:]] = 1
    slot = np.arange(len(query))
    word, at = query.copy(), query.copy()
    shared = size[query].copy()          # LCP of the query with the word reached
    need = shared.copy()                 # rows up to here are good
    row = np.zeros(len(query), np.int64)
    moving = np.ones(len(query), bool)
    while len(slot):
        go = np.flatnonzero(moving)
        if len(go):
            at[go] += 1
            over = at[go] > last[go]
            if over.any():
                keep = np.ones(len(slot), bool)
                keep[go[over]] = False
                slot, word, at, last, shared, need, row, moving = (x[keep] for x in (slot, word, at, last, shared, need, row, moving))
                go = np.flatnonzero(moving)
            common = lcp[at[go]]
            shared[go] = np.minimum(shared[go], common)
            back = common <= need[go]    # others still share a prefix that is over one edit
            hit = go[back]
            row[hit] = common[back]
            moving[hit] = False
        go = np.flatnonzero(~moving)
        if not len(go):
            continue
        ended = row[go] == size[at[go]]
        done = go[ended]
        if len(done):
            off = size[word[done]] - size[at[done]]
            near = np.abs(off) <= 1
            near[near] = stack[slot[done[near]], size[at[done[near]]], off[near] + 1] == 1
            hit = done[near]
            found.append((word[hit], at[hit], shared[hit].copy()))
            need[done] = row[done]
            moving[done] = True
        go = go[~ended]
        if not len(go):
            continue
        j, s, q = row[go], slot[go], word[go]
        ok = j + 1 < longest             # a longer word is over one edit anyway
        if not ok.all():
            need[go[~ok]] = j[~ok]
            moving[go[~ok]] = True
            go, j, s, q = go[ok], j[ok], s[ok], q[ok]
        letter = chars[start[at[go]] + j]
        old, left, best = stack[s, j], None, None
        for k in (-1, 0, 1):             # the query's first i letters
            i = j + 1 + k
            legal = (i >= 1) & (i <= size[q])
            differ = chars[start[q] + np.where(legal, i - 1, 0)] != letter
            cell = np.where(legal, old[:, k + 1] + differ, 3)
            if k < 1:
                cell = np.where((i >= 0) & (i <= size[q]), np.minimum(cell, old[:, k + 2] + 1), 3)
            if left is not None:
                cell = np.where(legal, np.minimum(cell, left + 1), cell)
            left = np.minimum(cell, 3).astype(np.uint8)
            stack[s, j + 1, k + 1] = left
            best = left if best is None else np.minimum(best, left)
        alive = best <= 1
        row[go[alive]] += 1
        need[go[~alive]] = j[~alive]
        moving[go[~alive]] = True
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*found))


def _near_in_groups(words, group, n, m, a, b):
    """Per word of a group that has near words there: index, their number, and
    the index of the most frequent one."""
    size = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    lcp = _adjacent_lcp(chars, start, size, group)
    border = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]]))
    last = border[np.searchsorted(border, np.arange(len(words)))]
    query = np.flatnonzero(last > np.arange(len(words)))
    # queries with like lists and lengths go together
    query = query[np.lexsort((last[query] - query, size[query]))]
    pairs, at = [], 0
    while at < len(query):
        to = len(query)
        room = np.flatnonzero((np.arange(1, to - at + 1)) * (size[query[at:to]] + 3) > CELLS // 3)
        if len(room):
            to = at + max(1, int(room[0]))
        pairs.append(scan(chars, start, size, lcp, query[at:to], last[query[at:to]]))
        at = to
    if not pairs:
        return None
    x, y, p = (np.concatenate(v) for v in zip(*pairs))
    place = np.minimum(p, m[x] - 1)
    own = (np.minimum(size[x], size[y]) == m[x]) & (place >= a[x]) & (place < b[x]) & (m[x] == m[y]) & (a[x] == a[y])
    x, y = x[own], y[own]
    if not len(x):
        return None
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.lexsort((y, -n[y], x))  # in a group a smaller index is a smaller word
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.concatenate([first, [len(x)]])), y[first]


def _near(batches):
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def work(rows):
        words = rows.column("word").to_pylist()
        cols = [rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "n", "m", "a", "b")]
        found = _near_in_groups(words, *cols)
        if found is not None:
            x, count, y = found
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in x], pa.string()), pa.array(count.astype(np.int64)), pa.array(cols[1][y]),
                                              pa.array([words[i] for i in y], pa.string())], schema=schema)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on
        if cut:
            yield from work(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if rows:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def _grouped(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    dealt = rows.select("key", "word", "n", "m", "a", "b").repartition(C.partitions(spark), "key").sortWithinPartitions("key", "word")
    return dealt.mapInArrow(_near, "word string, near long, best_n long, best string")


def near_words(words: DataFrame, least_letters: int = 5) -> DataFrame:
    """(word, n, n_near, best_n, best) for every row of ``words`` (distinct words
    and their counts): how many other words are at one edit, and the most frequent
    of them (of equals the smallest)."""
    rows = _thirds(words, least_letters)
    sizes = C.write_read(rows.groupBy("key").agg(F.count("*").alias("__size")).where(f"__size > {LIMIT}"), "crowded")
    if sizes.isEmpty():
        near = _grouped(rows)
    else:
        crowded = rows.join(sizes.select("key"), "key", "left_semi")
        near = _grouped(rows.join(sizes.select("key"), "key", "left_anti")).unionByName(_grouped(_places(crowded)))
    nothing = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    one = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))))
    return (nothing.unionByName(near.withColumn("n", F.lit(None).cast("long"))).groupBy("word")
            .agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), one.alias("__one"))
            .select("word", "n", "n_near", (-F.col("__one.k")).alias("best_n"), F.col("__one.w").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: pointers are followed by
    doubling. Counts at least double on the way, so few rounds are needed."""
    links = C.write_read(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = links.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved"))
        step = C.write_read(step, "links")
        links = step.select("word", "root")
        if step.where("__moved").isEmpty():
            return links


def group_variants(words: DataFrame, least_letters: int = 5, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with counts. A form
    is the most frequent near word, if it occurs ``factor`` times as often or more;
    the root is the last form of the chain."""
    words = C.write_read(words, "words")
    near = near_words(words, least_letters)
    has = F.col("best_n") >= factor * F.col("n")
    forms = C.write_read(near.select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants of the words of all whole texts."""
    return group_variants(count_words(docs, id_col, text_col))
