"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

Tokens are words (A-Z lower-cased, cut at space and U+0009 to U+000D), then one
end per text. The ``HEAD`` commonest tokens stand in classes of ``WIDTH``;
every other word, known or not, belongs to one of ``TAIL`` classes by a hash of
its last three bytes. The model is

    P(word | context) = P(class | context) * P(word | class, context)

with a softmax over the classes and, in the classes of common words, a softmax
over the words. Both sum hashed weights of four context features: the word
before, the two words before, and two skips (the second and the third word
before). In a tail class a word has its smoothed share of the class's counts,
and one share is left for unknown words, so that probabilities add up to one.

1. Token counts of all training texts: partial counts per task, then one
   shuffle. The counts never pass through the driver; only the HEAD commonest
   tokens and the sums per class do.
2. Training: the texts are written as symbols once, then in each round every
   task starts from the broadcast weights and makes AdaGrad steps over its part
   of the training positions (all positions of every text); the weights of all
   tasks meet in a tree, each row and cell averaged over the positions that
   touched it: a feature that only one task saw keeps what that task learned.
   The next round starts from there.
3. Scoring: texts are scored in blocks by sparse numpy batches. A block lists
   each of its rare words once, with the texts that hold it; these lists meet
   the counts in one shuffled join, in which a word has one row per block at
   most, and come back to their block as partial sums of the texts they touch.

The base score is that of smoothed unigrams over the same counts.

Defined cases: null texts are empty and have the end only; without training
rows all counts are 0 and the model is uniform over classes; rows that repeat
an id get a result each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C
from webspin.llm.op9_near_dedup import SPACE

HEAD, WIDTH, TAIL = 1024, 32, 64
CLASSES = HEAD // WIDTH + TAIL
START = HEAD + TAIL  # the symbol before a text
ROWS, CELLS = 1 << 13, 1 << 18
#: Rounds of training, each over all positions, and the step size.
ROUNDS, RATE = 2, 0.15
BATCH = 2048
#: Lines and cells of a batch that are worked on at once, so that they stay in the cache.
LINES, STRIP = 512, 1 << 14
BLOCK_BYTES = 3 << 20
#: Text of a block of scored rows, whose rare words are listed together.
SCORE_BYTES = 16 << 20
#: (word, text) pairs that are summed together after the join.
PAIRS = 1 << 20
#: Entries of a row that are added rank by rank; the others of a row at once.
RANKS = 24
END_TOKEN = 0  # index of the end among the common tokens
LOG10 = np.log(10.0)


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def gather_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of each span, one after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def binary_array(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive values of ``size`` bytes each."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, in the order of keys; the number of each key)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def word_hash(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return C.mix(C.span_hash(C.prefix_hash(low), start, end) + (end - start).astype(np.uint64))


class Tokens:
    """The tokens of a block of rows: distinct words (places in ``low``), and per
    token the row and the word."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low = C.LOWER[data]
        start, end, row = C.word_spans(self.low, off, SPACE)
        h = word_hash(self.low, start, end)
        first, self.word = distinct(h)
        self.hash, self.start, self.size = h[first], start[first], (end - start)[first]
        self.row, self.rows = row, len(off) - 1
        self.counts = np.bincount(row, minlength=self.rows)

    def positions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word or -1, place in its text) of every token, ends included."""
        n = self.counts + 1
        row = np.repeat(np.arange(self.rows), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        word = np.full(len(row), -1)
        word[place < self.counts[row]] = self.word
        return row, word, place

    def tails(self) -> np.ndarray:
        """tail_class of every distinct word."""
        crc = np.full(len(self.start), 0xFFFFFFFF, np.uint32)
        for back in (3, 2, 1):
            has = np.flatnonzero(self.size >= back)
            byte = self.low[self.start[has] + self.size[has] - back]
            crc[has] = CRC[(crc[has] ^ byte) & np.uint32(255)] ^ crc[has] >> np.uint32(8)
        return ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(TAIL)).astype(np.int64)

    def symbols(self, head: Head) -> np.ndarray:
        """The symbol of every distinct word, and that of the end as the last."""
        out = np.append(HEAD + self.tails(), END_TOKEN)
        if len(head.hash):
            at = np.minimum(np.searchsorted(head.hash, self.hash), len(head.hash) - 1)
            for w in np.flatnonzero(head.hash[at] == self.hash).tolist():
                a, n = int(self.start[w]), int(self.size[w])
                if self.low[a:a + n].tobytes() == head.words[at[w]]:
                    out[w] = head.index[at[w]]
        return out


class Head:
    """The common words by their hash."""

    def __init__(self, head: dict[bytes, int]):
        words = list(head)
        end = np.cumsum([len(w) for w in words], dtype=np.int64)
        start = end - np.array([len(w) for w in words], np.int64)
        h = word_hash(np.frombuffer(b"".join(words), np.uint8), start, end)
        order = np.argsort(h)
        self.hash, self.words = h[order], [words[i] for i in order]
        self.index = np.array([head[w] for w in self.words], np.int64)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL


class Model:
    def __init__(self, head: dict[bytes, int], head_counts: np.ndarray, n_tokens: int, n_kinds: int, tail_n: np.ndarray, tail_kinds: np.ndarray):
        """head: the common words' indexes from 1 on; head_counts[0] is that of the end."""
        self.head, self.n_tokens, self.n_kinds = head, n_tokens, n_kinds
        counts = np.zeros(HEAD)
        counts[:len(head_counts)] = head_counts
        self.head_counts = counts
        known = np.arange(HEAD) < len(head_counts)
        self.word_bias = np.where(known, np.log(counts + 0.5), -np.inf).reshape(-1, WIDTH).astype(np.float32)
        sums = np.concatenate([np.where(known, counts + 0.5, 0).reshape(-1, WIDTH).sum(axis=1), tail_n + 0.5 * (tail_kinds + 1)])
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(sums / sums.sum()).astype(np.float32)
        self.tail_log = np.log(tail_n + 0.5 * (tail_kinds + 1))
        self.base_log = np.log(n_tokens + 0.5 * (n_kinds + 1))
        self.weights = np.zeros((ROWS, CLASSES), np.float32)
        self.cells = np.zeros(CELLS, np.float32)

    def contexts(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Row of the weights for each of the four features of each position."""
        n = len(symbol)
        before = np.full((3, n), START)
        for k in (1, 2, 3):
            before[k - 1, k:] = symbol[:-k] if n > k else symbol[:0]
            before[k - 1][place < k] = START
        a, b, c = before.astype(np.uint64)
        s = np.uint64(START + 1)
        keys = np.stack([a, a * s + b + np.uint64(1 << 21), b + np.uint64(1 << 42), c + np.uint64(1 << 43)])
        return (C.mix(keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64)

    def class_sums(self, rows: np.ndarray, out: np.ndarray | None = None, more: np.ndarray | None = None) -> np.ndarray:
        """The classes' weights for each position, not yet probabilities."""
        z = self.weights.take(rows[0], axis=0, out=out, mode="clip")
        more = np.empty_like(z) if more is None else more[:len(z)]
        for r in rows[1:]:
            z += self.weights.take(r, axis=0, out=more, mode="clip")
        z += self.class_bias
        return z

    def class_logs(self, rows: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes: positions x CLASSES."""
        return _logs(self.class_sums(rows))

    def word_cells(self, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Cells of the words of a class for each feature: 4 x positions x WIDTH."""
        odd = np.uint64(0x9E3779B97F4A7C15)
        key = (rows * HEAD + group * WIDTH).astype(np.uint64) * odd
        cells = key[:, :, None] + np.arange(WIDTH, dtype=np.uint64) * odd
        cells >>= np.uint64(64 - 18)
        return cells.view(np.int64)

    def word_sums(self, cells: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The weights of the words of a class for each position."""
        z = self.word_bias[group]
        for c in cells:
            z += self.cells.take(c)
        return z

    def word_logs(self, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        return _logs(self.word_sums(self.word_cells(rows, group), group))

    def log_probs(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural log probability of each position; without the share of a
        rare word in its class."""
        rows, out = self.contexts(symbol, place), np.empty(len(symbol))
        common, group = _classes(symbol)
        buffers = [np.empty((BATCH, CLASSES), np.float32) for _ in range(2)]
        for at in range(0, len(symbol), BATCH):
            s = slice(at, at + BATCH)
            out[s] = _logs_of(self.class_sums(rows[:, s], buffers[0][:len(group[s])], buffers[1]), group[s])
            k = np.flatnonzero(common[s])
            if len(k):
                g = group[s][k]
                out[s][k] += _logs_of(self.word_sums(self.word_cells(rows[:, s][:, k], g), g), symbol[s][k] % WIDTH)
        return out

    def learn(self, symbol: np.ndarray, place: np.ndarray, squares: list[np.ndarray], touched: list[np.ndarray]) -> None:
        """AdaGrad steps on all positions; ``touched`` counts the positions of
        each row, and of each row with each class of common words."""
        rows = self.contexts(symbol, place)
        common, group = _classes(symbol)
        gradient, sums = np.empty((BATCH, CLASSES), np.float32), np.zeros(CELLS)
        buffers = [np.empty((LINES, CLASSES), np.float32) for _ in range(3)]
        for at in range(0, len(symbol), BATCH):
            s = slice(at, at + BATCH)
            r, t = rows[:, s], group[s]
            g = gradient[:len(t)]
            for a in range(0, len(t), LINES):
                _shares(self.class_sums(r[:, a:a + LINES], g[a:a + LINES], buffers[0]))
            g[np.arange(len(g)), t] -= 1
            self._step_rows(g, r, squares[0], touched[0], buffers)
            k = np.flatnonzero(common[s])
            if len(k):
                r, t, word = r[:, k], t[k], symbol[s][k] % WIDTH
                for a in range(0, len(k), LINES):
                    of = slice(a, a + LINES)
                    cells = self.word_cells(r[:, of], t[of])
                    g = _shares(self.word_sums(cells, t[of]))
                    g[np.arange(len(g)), word[of]] -= 1
                    g = g.ravel().astype(np.float64)  # add.at is slow on the dtype objects of a model that was sent to a task
                    for c in cells:
                        np.add.at(sums, c.ravel(), g)
                np.add.at(touched[1], (r * (HEAD // WIDTH) + t).ravel(), 1.0)
                self._step_cells(sums, squares[1])

    def _step_rows(self, g: np.ndarray, rows: np.ndarray, squares: np.ndarray, touched: np.ndarray, buffers: list[np.ndarray]) -> None:
        """A step of the distinct values of ``rows``, each with the sum of the
        lines of ``g`` where it occurs; a column of ``rows`` belongs to a line of
        ``g``. Rows are taken by falling number of entries, so that the nth entries
        of all rows that have one are added to the first lines of the sums."""
        flat = rows.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        key, line = flat[order], np.tile(np.arange(len(g)), len(rows))[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(flat)))
        by = np.argsort(-n, kind="stable")
        first, n = first[by], n[by]
        at_rows = key[first].astype(np.int64)
        touched[at_rows] += n
        for a in range(0, len(n), LINES):
            f, m, r = first[a:a + LINES], n[a:a + LINES], at_rows[a:a + LINES]
            total, more, of = (x[:len(f)] for x in buffers)
            g.take(line[f], axis=0, out=total, mode="clip")
            for k in range(1, min(int(m[0]), RANKS)):
                have = int(np.searchsorted(-m, -k))
                total[:have] += g.take(line[f[:have] + k], axis=0, out=more[:have], mode="clip")
            have = int(np.searchsorted(-m, -RANKS))
            if have:
                size = m[:have] - RANKS
                total[:have] += np.add.reduceat(g[gather_spans(line, f[:have] + RANKS, size)], np.cumsum(size) - size, axis=0)
            squares.take(r, axis=0, out=of, mode="clip")
            of += np.multiply(total, total, out=more)
            squares[r] = of
            of += 1
            total *= RATE
            total /= np.sqrt(of, out=of)
            self.weights.take(r, axis=0, out=of, mode="clip")
            of -= total
            self.weights[r] = of

    def _step_cells(self, sums: np.ndarray, squares: np.ndarray) -> None:
        """A step of all cells; ``sums`` are zero afterwards."""
        total, of = np.empty((2, STRIP), np.float32)
        for a in range(0, CELLS, STRIP):
            square = squares[a:a + STRIP]
            total[:] = sums[a:a + STRIP]
            sums[a:a + STRIP] = 0
            square += np.multiply(total, total, out=of)
            np.sqrt(np.add(square, 1, out=of), out=of)
            total *= RATE
            total /= of
            self.cells[a:a + STRIP] -= total

    def touched_cells(self, pairs: np.ndarray) -> np.ndarray:
        """Positions that touched each cell, from those of each row with each
        class of common words."""
        out = np.zeros(CELLS)
        used = np.flatnonzero(pairs)
        for a in range(0, len(used), 4096):
            some = used[a:a + 4096]
            cells = self.word_cells((some // (HEAD // WIDTH))[None], some % (HEAD // WIDTH))
            out += np.bincount(cells.ravel(), np.repeat(pairs[some], WIDTH), CELLS)
        return out


def _classes(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a symbol is a common word, its class)."""
    common = symbol < HEAD
    return common, np.where(common, symbol // WIDTH, symbol - HEAD + HEAD // WIDTH)


def _logs(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _logs_of(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The target's column of _logs(z)."""
    z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), target]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def _shares(z: np.ndarray) -> np.ndarray:
    """Softmax of each line, in place."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _count_tokens(batches):
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])
    for _, data, off in C.text_pieces(batches, "__text", BLOCK_BYTES):
        t = Tokens(data, off)
        yield pa.RecordBatch.from_arrays([binary_array(gather_spans(t.low, t.start, t.size), t.size), pa.array(np.bincount(t.word, minlength=len(t.size)))], schema=schema)


def _encode(shared):
    """Texts to symbols: one row per piece with all its symbols and the tokens of
    each text."""
    def run(batches):
        for _, data, off in C.text_pieces(batches, "__text", 1 << 20):
            t = Tokens(data, off)
            symbols = t.symbols(shared.value)[t.positions()[1]].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (symbols, (t.counts + 1).astype(np.int64))], names=["symbols", "n"])
    return run


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the counts (token, n) of the words of ``docs``."""
    spark = docs.sparkSession
    base = docs.select(F.col(text_col).alias("__text"))
    counts = C.write_read(base.mapInArrow(_count_tokens, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    n_texts = base.count()
    top = counts.orderBy(F.desc("n"), "token").limit(HEAD - 1).collect()
    head = {bytes(r["token"]): i + 1 for i, r in enumerate(top)}
    last = F.when(F.length("token") > 3, F.expr("substring(token, -3, 3)")).otherwise(F.col("token"))
    tail_n, tail_kinds = np.zeros(TAIL), np.zeros(TAIL)
    for r in counts.groupBy((F.crc32(last) % TAIL).alias("cls")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        tail_n[r["cls"]], tail_kinds[r["cls"]] = r["n"], r["kinds"]
    n_words, n_kinds = int(tail_n.sum()), int(tail_kinds.sum())
    for r in top:
        tail_n[tail_class(bytes(r["token"]))] -= r["n"]
        tail_kinds[tail_class(bytes(r["token"]))] -= 1
    model = Model(head, np.array([n_texts] + [r["n"] for r in top], float), n_words + n_texts, n_kinds + 1 if n_texts else 0, tail_n, tail_kinds)
    shared = spark.sparkContext.broadcast(Head(head))
    encoded = base.mapInArrow(_encode(shared), "symbols binary, n binary").persist(StorageLevel.DISK_ONLY)

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def steps(batches, now=now):
            import copy

            own = copy.copy(now.value)
            own.weights, own.cells = own.weights.copy(), own.cells.copy()
            squares = [np.zeros_like(own.weights), np.zeros_like(own.cells)]
            touched = [np.zeros(ROWS), np.zeros(ROWS * (HEAD // WIDTH))]
            for b in batches:
                for symbols, n in zip(b.column("symbols"), b.column("n")):
                    n = np.frombuffer(n.as_buffer(), np.int64)
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own.learn(np.frombuffer(symbols.as_buffer(), np.uint16).astype(np.int64), place, squares, touched)
            if touched[0].any():
                n_rows, n_cells = touched[0].astype(np.float32), own.touched_cells(touched[1]).astype(np.float32)
                parts = n_rows, n_cells, own.weights * n_rows[:, None], own.cells * n_cells
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["nw", "nc", "w", "c"])

        parts = encoded.mapInArrow(steps, "nw binary, nc binary, w binary, c binary").rdd.map(lambda r: tuple(np.frombuffer(x, np.float32) for x in r))
        total_parts = parts.treeAggregate(None, _add, _add, depth=3)
        if total_parts:
            n_rows, n_cells, w, c = total_parts
            w = w.reshape(ROWS, CLASSES)
            # what no position touched stays as it is
            model.weights = np.where(n_rows[:, None] > 0, w / np.maximum(n_rows, 1)[:, None], model.weights).astype(np.float32)
            model.cells = np.where(n_cells > 0, c / np.maximum(n_cells, 1), model.cells).astype(np.float32)
    encoded.unpersist()
    return model, counts


def _add(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    return tuple(x + y for x, y in zip(a, b))


SCORED = "token binary, block long, docs binary, ids binary, known_n binary, held binary, part binary, base binary, n binary"


def _score_blocks(shared):
    """One row per block with its texts (its token holds a space, as no word
    does), and one row per rare word of the block: the texts that hold it and
    how often."""
    names = ["token", "block", "docs", "ids", "known_n", "held", "part", "base", "n"]
    schema = pa.schema([("token", pa.binary()), ("block", pa.int64())] + [(x, pa.binary()) for x in names[2:]])

    def run(batches):
        model, task = shared.value, TaskContext.get().partitionId()
        head = Head(model.head)
        texts: list[tuple] = []  # per piece: nulls, ids, known, held, part, base, n
        rare: list[tuple] = []  # per piece: hashes, bytes and sizes of rare words
        pairs: list[tuple] = []  # per piece: rare word, text, how often
        nth = n_texts = n_rare = n_bytes = 0

        def out():
            block = (task << 24) + nth
            nulls, ids, known, held, part, base, n = (np.concatenate(x) for x in zip(*texts))
            one = [[f" {block}".encode()], [block], [nulls.tobytes()], [ids.tobytes()], [known.tobytes()], [held.tobytes()], [part.tobytes()], [base.tobytes()], [n.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(one, schema)], schema=schema)
            hashes, data, size = (np.concatenate(x) for x in zip(*rare))
            first, number = distinct(hashes)
            start = (np.cumsum(size) - size)[first]
            size = size[first]
            word, doc, n = (np.concatenate(x) for x in zip(*pairs))
            word = number[word]
            order = np.argsort(word)
            doc, n, cut = doc[order].astype(np.int32), n[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(first)))])
            for a in range(0, len(first), 20000):
                b = min(len(first), a + 20000)
                each, null = np.diff(cut[a:b + 1]) * 4, pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays([
                    binary_array(gather_spans(data, start[a:b], size[a:b]), size[a:b]), pa.array(np.full(b - a, block)), binary_array(doc[cut[a]:cut[b]].view(np.uint8), each),
                    null, null, null, null, null, binary_array(n[cut[a]:cut[b]].view(np.uint8), each)], schema=schema)
        for rows, data, off in C.text_pieces(batches, "__text", BLOCK_BYTES):
            if texts and n_bytes + len(data) > SCORE_BYTES:
                yield from out()
                texts, rare, pairs = [], [], []
                nth, n_texts, n_rare, n_bytes = nth + 1, 0, 0, 0
            t = Tokens(data, off)
            row, word, place = t.positions()
            sym_of = t.symbols(head)
            sym = sym_of[word]
            common = sym < HEAD
            part = model.log_probs(sym, place) - np.where(common, 0.0, model.tail_log[np.maximum(sym - HEAD, 0)])
            c = model.head_counts[np.minimum(sym, HEAD - 1)]
            base = np.where(common, np.log(c + 0.5), 0.0) - model.base_log
            known = np.bincount(row, common & (c > 0), t.rows).astype(np.int64)
            ids = rows.column("__id")
            texts.append((np.asarray(ids.is_null()).astype(np.uint8), np.asarray(ids.fill_null(0)), known, np.asarray(rows.column("__held")).astype(np.uint8),
                          np.bincount(row, part, t.rows), np.bincount(row, base, t.rows), (t.counts + 1).astype(np.int64)))
            # (word, text) with counts, in the order of words
            is_rare = sym_of[:-1] >= HEAD
            at = np.flatnonzero(is_rare[t.word])
            pair = np.sort(t.word[at] * np.int64(t.rows) + t.row[at])
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            few = np.flatnonzero(is_rare)
            rare.append((t.hash[few], gather_spans(t.low, t.start[few], t.size[few]), t.size[few]))
            pairs.append(((np.cumsum(is_rare) - 1)[pair[first] // t.rows] + n_rare, pair[first] % t.rows + n_texts, np.diff(np.append(first, len(pair)))))
            n_texts, n_rare, n_bytes = n_texts + t.rows, n_rare + len(few), n_bytes + len(data)
        if texts:
            yield from out()
    return run


def _sum_words():
    """Joined rows to the sums of each block's texts, for some rows at a time;
    rows of texts pass."""
    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("ids", pa.binary()), ("known_n", pa.binary()), ("held", pa.binary()), ("part", pa.binary()), ("base", pa.binary()), ("n", pa.binary())])

    def out(held):
        block, doc, n, c = (np.concatenate(x) for x in zip(*held))
        names, which = np.unique(block, return_inverse=True)
        key = which.astype(np.int64) << 32 | doc
        first, number = distinct(key)
        some = lambda x: np.bincount(number, x)
        at, part, known = key[first], some(n * np.log(c + 0.5)), some(n * (c > 0)).astype(np.int32)
        size = np.bincount(at >> 32, minlength=len(names))
        null = pa.nulls(len(names), pa.binary())
        values = lambda x: binary_array(x.view(np.uint8), size * x.itemsize)
        return pa.RecordBatch.from_arrays([pa.array(names), values(at.astype(np.int32)), null, values(known), null, values(part), null, null], schema=schema)

    def run(batches):
        held, n_pairs = [], 0
        for b in batches:
            is_word = ~np.asarray(b.column("ids").is_valid())
            texts = b.filter(pa.array(~is_word))
            if texts.num_rows:
                yield pa.RecordBatch.from_arrays([texts.column(f.name) for f in schema], schema=schema)
            words = b.filter(pa.array(is_word))
            if words.num_rows:
                (d, off), (n, _) = C.string_view(words.column("docs")), C.string_view(words.column("n"))
                size = np.diff(off) // 4
                held.append((np.repeat(np.asarray(words.column("block")), size), np.frombuffer(d.tobytes(), np.int32).astype(np.int64), np.frombuffer(n.tobytes(), np.int32).astype(float),
                             np.repeat(np.asarray(words.column("c").fill_null(0)), size)))
                n_pairs += len(held[-1][0])
            if n_pairs > PAIRS:
                yield out(held)
                held, n_pairs = [], 0
        if held:
            yield out(held)
    return run


def _finish(n_tokens: int):
    """Rows sorted by block: the row of texts first, then its sums."""
    def run(batches):
        state = None

        def out():
            nulls, ids, known, held, part, base, n = state
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(held.astype(bool)), pa.array(n), pa.array(known),
                pa.array(np.full(len(ids), n_tokens)), pa.array(base / LOG10), pa.array(part / LOG10)],
                names=["__id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        for b in batches:
            for r in b.to_pylist():
                if r["ids"] is not None:
                    if state is not None:
                        yield out()
                    get = lambda x, t: np.frombuffer(r[x], t).copy()
                    state = [get("docs", np.uint8), get("ids", np.int64), get("known_n", np.int64), get("held", np.uint8), get("part", np.float64), get("base", np.float64), get("n", np.int64)]
                else:
                    docs, part = np.frombuffer(r["docs"], np.int32), np.frombuffer(r["part"], np.float64)
                    state[2][docs] += np.frombuffer(r["known_n"], np.int32)
                    state[4][docs] += part
                    state[5][docs] += part
        if state is not None:
            yield out()
    return run


def score_texts(docs: DataFrame, held_out, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, held_out (the given condition),
    n_tokens, n_known (tokens with a count), train_tokens, base_score and score
    (log10 probabilities of the text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(held_out, F.lit(False)).alias("__held"), F.col(text_col).alias("__text"))
    blocks = base.mapInArrow(_score_blocks(shared), SCORED)
    # a left join: the rows of texts match no word and pass; the counts are dealt by token, never broadcast
    joined = blocks.join(counts.withColumnRenamed("n", "c").hint("merge"), "token", "left").select("token", "c", "block", "docs", "ids", "known_n", "held", "part", "base", "n")
    sums = joined.mapInArrow(_sum_words(), "block long, docs binary, ids binary, known_n binary, held binary, part binary, base binary, n binary")
    sums = sums.repartition(C.partitions(spark), "block").sortWithinPartitions("block", F.col("ids").isNull())
    return sums.mapInArrow(_finish(model.n_tokens), "__id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("__id", id_col)
