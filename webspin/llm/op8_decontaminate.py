"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words; the patterns are all runs of ``run`` consecutive words
of a benchmark item (an item of fewer words is one pattern). Patterns of one
length m share three tables: a block shift table (block: two words, one for
patterns of one word) that says how far the search may move on, a hash of the
whole pattern that selects candidates where the shift is 0, and the pattern's
words, compared directly. A text is searched in lanes of ``m - 1`` positions
that move on together: most lanes are done after one look at the shift table,
as no pattern has the block there.

The tables of one block of patterns (``BLOCK`` patterns at most) go to the
executors; a larger benchmark is searched in several passes over the texts,
so that no broadcast grows with it.

Defined cases: null texts have no words; items without words are no pattern;
equal items count one each; rows that repeat an id get a result each; null
item ids never show up in the list, but their windows hit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

#: Patterns searched in one pass (bound of what is broadcast: 10 words each).
BLOCK = 200_000
SHIFT_BITS = 20
#: Bytes of a word after lower-casing: 0-9, a-z and all of U+0080 and above.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def words_of(data: np.ndarray, off: np.ndarray):
    """(lower-cased bytes, starts, ends, rows, hashes) of the words of the rows."""
    low = C.LOWER[data]
    start, end, row = C.word_spans(low, off, WORD)
    return low, start, end, row, C.span_hash(C.prefix_hash(low), start, end)


def _join_hash(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each position."""
    out = np.zeros(len(at), np.uint64)
    for k in range(m):
        out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    return out


class Patterns:
    """Search tables of patterns (lists of words as bytes) of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]], owners: list[list[int]]):
        self.m = len(patterns[0])
        self.width = min(2, self.m)
        flat = [w for p in patterns for w in p]
        off = np.concatenate([[0], np.cumsum([len(w) for w in flat])])
        data = np.frombuffer(b"".join(flat), np.uint8)
        h = C.span_hash(C.prefix_hash(data), off[:-1], off[1:])
        first = np.arange(len(patterns)) * self.m
        self.most = self.m - self.width + 1
        self.shift = np.full(1 << SHIFT_BITS, self.most, np.uint8)
        for k in range(self.m - self.width + 1):  # the block that ends k places before the pattern's end
            cell = self.cells(h, first + self.m - self.width - k)
            np.minimum.at(self.shift, cell, np.uint8(k))
        key = _join_hash(h, first, self.m)
        order = np.argsort(key, kind="stable")
        self.keys, self.words, self.owners = key[order], [patterns[i] for i in order], [owners[i] for i in order]

    def cells(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (_join_hash(h, at, self.width) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    def search(self, low, start, end, h, first, last):
        """(word position, pattern) of every occurrence in the texts whose
        words are first[i]:last[i]."""
        m, found_at, found = self.m, [], []
        n = last - first
        rows = np.flatnonzero(n >= m)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # lane: ends of possible matches [pos, stop), `most` of them
        lanes = (n[rows] - m + 1 + self.most - 1) // self.most
        row = np.repeat(rows, lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = first[row] + nth * self.most + m - 1
        stop = np.minimum(pos + self.most, last[row])
        while len(pos):
            jump = self.shift[self.cells(h, pos - self.width + 1)].astype(np.int64)
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                at = pos[hit] - m + 1
                key = _join_hash(h, at, m)
                lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                for i in np.flatnonzero(hi > lo):
                    p = int(at[i])
                    text = tuple(low[start[p + k]:end[p + k]].tobytes() for k in range(m))
                    for c in range(int(lo[i]), int(hi[i])):
                        if self.words[c] == text:
                            found_at.append(p)
                            found.append(c)
            pos = pos + np.maximum(jump, 1)
            alive = pos < stop
            pos, stop = pos[alive], stop[alive]
        return np.array(found_at, np.int64), np.array(found, np.int64)


def pattern_rows(items: DataFrame, id_col: str, text_col: str, run: int) -> DataFrame:
    """(pattern: array of words, owners: ids of the items that have it)."""
    def split(batches):
        for b in batches:
            out = {"item": [], "pattern": []}
            data, off = C.string_view(b.column("__text"))
            low, start, end, row, _ = words_of(data, off)
            words = [low[s:e].tobytes() for s, e in zip(start, end)]
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            for i in range(b.num_rows):
                ws = words[first[i]:first[i + 1]]
                for p in ([ws[k:k + run] for k in range(len(ws) - run + 1)] if len(ws) >= run else [ws] if ws else []):
                    out["item"].append(b.column("__id")[i].as_py())
                    out["pattern"].append(p)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.int64()), ("pattern", pa.list_(pa.binary()))]))

    base = items.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    rows = base.mapInArrow(split, "item long, pattern array<binary>")
    return rows.groupBy("pattern").agg(F.collect_set("item").alias("owners"))


FOUND = [("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.int64()))]


def _search(tables: list[Patterns], keep_text: bool):
    """Adds what the tables find to the hits and items of earlier passes."""
    schema = pa.schema([("__id", pa.int64())] + [("__text", pa.string())] * keep_text + FOUND)

    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__text"):
            low, start, end, row, h = words_of(data, off)
            first = np.searchsorted(row, np.arange(len(off)))
            first, last = first[:-1], first[1:]
            cover = np.zeros(len(h) + 1, np.int32)
            items = {i: set(x) for i, x in enumerate(rows.column("items").to_pylist()) if x}
            before = rows.column("hits").to_pylist()
            for t in tables:
                at, which = t.search(low, start, end, h, first, last)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + t.m, -1)
                for p, c in zip(at, which):
                    items.setdefault(int(row[p]), set()).update(t.owners[c])
            hit = np.cumsum(cover[:-1]) > 0
            spans = []
            for i in range(len(first)):
                bits = np.packbits(hit[first[i]:last[i]])
                if before[i]:
                    bits = bits | np.frombuffer(before[i], np.uint8)
                spans.append(bits.tobytes() if bits.any() else None)
            found = [pa.array(last - first), pa.array(spans, pa.binary()),
                     pa.array([sorted(items[i], key=lambda x: (x is None, x)) if i in items else None for i in range(len(first))], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([rows.column("__id")] + [rows.column("__text").cast(pa.string())] * keep_text + found, schema=schema)
    return run


def _tables(found: list) -> list[Patterns]:
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(len(r["pattern"]), []).append(r)
    return [Patterns([tuple(bytes(w) for w in r["pattern"]) for r in rs], [r["owners"] for r in rs]) for _, rs in sorted(by.items())]


def pattern_blocks(items: DataFrame, item_col: str, item_text_col: str, run: int):
    """(search tables as a broadcast, do more follow) of each block of about
    BLOCK patterns, at least one block; only one block at a time is held here."""
    patterns = C.write_read(pattern_rows(items, item_col, item_text_col, run), "patterns")
    passes = max(1, -(-patterns.count() // BLOCK))
    for k in range(passes):
        yield items.sparkSession.sparkContext.broadcast(_tables(patterns.where(F.pmod(F.hash("pattern"), F.lit(passes)) == k).collect())), k + 1 < passes


def search_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text", run: int = 10) -> DataFrame:
    """(__id, n_words, hits, items) for each row: hits is a bit for each word
    (null if none is hit), items the ids of the items with occurring windows."""
    found = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.lit(None).cast("long").alias("n_words"),
                        F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<long>").alias("items"))
    for tables, more in pattern_blocks(items, item_col, item_text_col, run):
        found = found.mapInArrow(lambda it, t=tables, m=more: _search(t.value, m)(it),
                                 "__id long, " + "__text string, " * more + "n_words long, hits binary, items array<long>")
        if more:  # one block is searched, written and let go before the next one
            found = C.write_read(found, "searched")
            tables.unpersist()
    return found


def _report(batches):
    schema = pa.schema([("__id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    for b in batches:
        n_hit, n_items, sha = [], [], []
        words = b.column("n_words").to_pylist()
        for hits, items in zip(b.column("hits").to_pylist(), b.column("items").to_pylist()):
            n_hit.append(int(np.unpackbits(np.frombuffer(hits or b"", np.uint8)).sum()))
            names = sorted(str(i) for i in items or () if i is not None)
            n_items.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
                                          pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())], schema=schema)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", run: int = 10) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_hit (words inside an
    occurrence), n_items, items_sha256 (their ids as sorted strings, joined by
    commas) and contaminated (n_hit > 0)."""
    found = search_benchmark(docs, items, id_col, text_col, item_col, item_text_col, run)
    return found.mapInArrow(_report, "__id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumnRenamed("__id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", run: int = 10) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark window, all
    columns as they are."""
    out = docs
    for tables, more in pattern_blocks(items, item_col, item_text_col, run):
        def clean(batches, shared=tables):
            for rows, data, off in C.text_pieces(batches, text_col):
                low, start, end, row, h = words_of(data, off)
                first = np.searchsorted(row, np.arange(len(off)))
                keep = np.ones(rows.num_rows, bool)
                for t in shared.value:
                    keep[row[t.search(low, start, end, h, first[:-1], first[1:])[0]]] = False
                yield rows.filter(pa.array(keep))
        out = out.mapInArrow(clean, docs.schema)
        if more:
            out = C.write_read(out, "searched")
            tables.unpersist()
    return out
