"""Toxicity by the nearest labelled examples.

1. A bounded, hash-chosen set of labelled rows per class becomes the examples
   (``examples_per_class``). All their words (lower-cased runs of letters, whole)
   are terms; document frequencies are counted over all documents.
2. Every text becomes a TF-IDF vector of unit length over these terms. A word
   that no example has would scale all cosines of a text alike, so it changes no
   order and is left out.
3. The examples are kept in an inverted index whose postings come in blocks of
   64 examples of one label, language and length, each with its largest weight.
   A term of an eighth of the examples or more has a full row of weights in place
   of a list; the rows are multiplied with many texts at once. For a text, the
   sums over rows, and the products of its other weights with the maxima, bound
   the cosine of every block. The sums over rows alone are no more than the
   cosines, so blocks whose bound is below the k-th best of these of their label
   hold no neighbour. Their postings are left out where they are many. Where
   most blocks stay, whole lists are read at once, and those of the next texts
   without asking for bounds. The neighbours are exactly the k nearest of each
   label.
4. The neighbours vote with the terms that they share with the text: each term's
   part of the cosine, times how surely its presence depends on the label.
   A logistic function of the votes of both labels and of their ratio, fitted on
   the examples (each without itself, and weighted to the true share of the
   labels), gives a calibrated score. The neighbours are the evidence.

Defined cases: null and empty texts, and texts without any term, have no
neighbours and get the calibrated score of no vote; without labelled rows every
score is 0; a row labelled twice counts as toxic if any label says so; equal
cosines go to the smaller example id; rows that repeat an id get a result each;
an example row that repeats counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

EXAMPLES_PER_CLASS = 4000
BLOCK, NEIGHBOURS = 64, 15
#: Standard errors of a difference between labels at which a term counts in full.
SURE = 5.0
#: Standard errors up to which it counts nothing.
NOISE = 2.0
#: Terms of 1 / ROWS of the examples or more are kept as rows.
ROWS = 8
#: Lists are read whole unless fewer than 1 / MOST of a text's (term, block) entries stay.
MOST = 2
#: Texts whose lists are read whole, without bounds, after one whose bounds left out few.
IDLE = 7
#: Lists of fewer postings are gathered by index, longer ones copied one by one.
SHORT = 48
#: Texts whose common terms are multiplied at once.
TOGETHER = 64
#: Characters of the texts whose words are looked up at once.
LOOKED_UP = 1 << 20
NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: ASCII signs that are no letters to a space.
SPACES = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    """The lower-cased runs of letters (``[^\\W\\d_]+``) in UTF-8."""
    low = text.lower()
    if not low.isascii():
        for c in set(NOT_ASCII.findall(low)):
            if c.isdecimal() or not c.isalnum():
                low = low.replace(c, " ")
    return low.encode().translate(SPACES).split()


class Vocabulary:
    """Terms with their inverse document frequencies and label dependence."""

    def __init__(self, terms: list[str], idf: np.ndarray, gain: np.ndarray):
        self.at = {t: i for i, t in enumerate(terms)}
        self.idf, self.gain = idf, gain

    def count(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, how often it occurs in it), in order; each distinct word
        of the texts is looked up once."""
        words = [words_of(t or "") for t in texts]
        found = pa.array(list(chain.from_iterable(words)), pa.large_binary()).dictionary_encode()
        kinds = found.dictionary.cast(pa.large_string()).to_pylist()
        term = np.fromiter(map(self.at.get, kinds, repeat(-1)), np.int64, len(kinds))[found.indices.to_numpy()]
        key = np.repeat(np.arange(len(texts)) << 32, [len(w) for w in words])[term >= 0] | term[term >= 0]
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        return key[first] >> 32, (key[first] & 0xFFFFFFFF).astype(np.int32), n

    def counts(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms in order, how often each occurs) of each text."""
        row, term, n = self.count(texts)
        cut = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        return [(term[a:b], n[a:b].astype(np.int32)) for a, b in zip(cut, cut[1:])]

    def weigh(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of unit length; empty without any term."""
        w = (1 + np.log(n)) * self.idf[terms]
        return terms, w / math.sqrt(float(w @ w)) if len(w) else w

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.weigh(*self.counts([text])[0])

    def vectors(self, texts: list):
        """The vector of each text, TOGETHER vectors at a time."""
        for some in pieces(texts):
            row, term, n = self.count(some)
            w = (1 + np.log(n)) * self.idf[term]
            w /= np.sqrt(np.bincount(row, w * w, len(some)))[row]
            cut = np.searchsorted(row, np.arange(len(some) + 1)).tolist()
            found = [(term[a:b], w[a:b]) for a, b in zip(cut, cut[1:])]
            for a in range(0, len(found), TOGETHER):
                yield found[a:a + TOGETHER]


def pieces(texts: list):
    """Runs of texts of LOOKED_UP characters or little more."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= LOOKED_UP:
            yield some
            some, size = [], 0
    if some:
        yield some


def label_gain(t1: np.ndarray, t0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """0 to 1 per term: how surely its share of label-1 examples (t1 of n1)
    differs from that of the others (t0 of n0); 0 within the noise and where a
    label has no example."""
    if not n1 or not n0:
        return np.zeros(len(t1))
    z = np.abs(t1 / n1 - t0 / n0) / np.sqrt((t1 + t0 + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
    return np.where(z > NOISE, np.minimum(1.0, (z / SURE) ** 4), 0.0)


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each span."""
    at = np.repeat(first - (np.cumsum(size, dtype=first.dtype) - size), size)
    at += np.arange(len(at), dtype=at.dtype)
    return at


class Index:
    """Labelled examples by term and block, and the calibration of their votes."""

    def __init__(self, vocabulary: Vocabulary, examples: list[tuple], rate: float):
        """examples: (id, label, terms, weights); rate: share of label 1 in the labelled rows."""
        self.vocabulary, self.rate = vocabulary, rate
        # blocks hold examples of one label with the same most common term (a language) and like lengths
        idf = vocabulary.idf
        place = [(e[1], int(e[2][np.argmin(idf[e[2]])]) if len(e[2]) else -1, len(e[2]), -1 if e[0] is None else e[0], i) for i, e in enumerate(examples)]
        examples = [examples[p[-1]] for p in sorted(place)]
        self.ids = np.array([e[0] if e[0] is not None else -1 for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.int64)
        self.size = len(examples)
        self.zeros = self.size - int(self.labels.sum())
        block0 = -(-self.zeros // BLOCK)
        nth = np.arange(self.size)
        self.block_of = np.where(self.labels == 0, nth // BLOCK, block0 + (nth - self.zeros) // BLOCK).astype(np.int32)
        self.blocks = block0 + -(-(self.size - self.zeros) // BLOCK)
        self.block_label = (np.arange(self.blocks) >= block0).astype(np.int64)
        self.block_first = np.flatnonzero(np.concatenate([[True], self.block_of[1:] != self.block_of[:-1]])) if self.size else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum([len(e[2]) for e in examples], dtype=np.int64)]) if examples else np.zeros(1, np.int64)
        terms = np.concatenate([e[2] for e in examples]).astype(np.int32) if examples else np.zeros(0, np.int32)
        weights = np.concatenate([e[3] for e in examples]).astype(np.float64) if examples else np.zeros(0)
        who = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(first))
        # terms that count in votes
        says = vocabulary.gain[terms] > 0
        self.say_of = np.where(vocabulary.gain > 0, np.cumsum(vocabulary.gain > 0) - 1, -1).astype(np.int32)
        self.say_terms, self.say_weights = self.say_of[terms[says]], weights[says] * vocabulary.gain[terms[says]]
        self.say_first = np.concatenate([[0], np.cumsum(says)])[first]
        # common terms as rows, the others as postings
        common = np.flatnonzero(np.bincount(terms, minlength=len(vocabulary.at)) * ROWS >= max(self.size, BLOCK))
        self.row_of = np.full(len(vocabulary.at), -1, np.int32)
        self.row_of[common] = np.arange(len(common))
        row = self.row_of[terms]
        self.rows = np.zeros((len(common), self.size))
        self.rows[row[row >= 0], who[row >= 0]] = weights[row >= 0]
        order = np.lexsort((who, terms))
        order = order[row[order] < 0]
        self.post_who, self.post_weight, term = who[order], weights[order], terms[order].astype(np.int64)
        # one entry for each (term, block): its postings and their largest weight
        cell = term * max(1, self.blocks) + self.block_of[self.post_who] if len(term) else term
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.cell_first = np.append(first, len(cell)).astype(np.int32)
        self.cell_block = self.block_of[self.post_who[first]]
        self.cell_max = np.maximum.reduceat(self.post_weight, first) if len(first) else np.zeros(0)
        self.term_first = np.searchsorted(term[first], np.arange(len(vocabulary.at) + 1)).astype(np.int32)
        self.beta = np.zeros(4)
        self.shared = self.dense = None
        self.idle = 0

    def __getstate__(self):
        return self.__dict__ | {"shared": None, "dense": None, "idle": 0}

    def broadcast(self, spark):
        """One broadcast for the calibration and all uses (the calibration itself
        travels with the functions)."""
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self)
        return self.shared

    def _lists(self, first: np.ndarray, last: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums over spans of the postings, each with its weight."""
        if not len(first):
            return np.zeros(self.size)
        size = last - first
        long = size >= SHORT
        spans = [slice(a, b) for a, b in zip(first[long].tolist(), last[long].tolist())]
        short = _places(first[~long], size[~long])
        weight = np.concatenate([self.post_weight.take(short)] + [self.post_weight[s] for s in spans])
        weight *= np.concatenate([np.repeat(weights[~long], size[~long]), np.repeat(weights[long], size[long])])
        return np.bincount(np.concatenate([self.post_who.take(short)] + [self.post_who[s] for s in spans]), weight, self.size)

    def common(self, vectors: list) -> np.ndarray:
        """The common terms' part of the cosines, a row per vector."""
        q = np.zeros((len(vectors), len(self.rows)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row_of[terms]
            q[i, row[row >= 0]] = weights[row >= 0]
        return q @ self.rows

    def nearest(self, vector, without: int | None = None, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each label the NEIGHBOURS examples with the highest cosine above
        0, all of them best first. Blocks whose bound is below the k-th best
        sum over common terms of their label have none. ``common``: the
        vector's row of common().
        ``without``: an example id that is left out."""
        terms, weights = vector
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        row = self.row_of[terms]
        if common is None:
            common = self.common([vector])[0]
        terms, weights = terms[row < 0], weights[row < 0]
        allowed = None if without is None else self.ids != without
        a, b = self.term_first[terms], self.term_first[terms + 1]
        use = None
        if not self.idle:
            n = b - a
            cells = _places(a, n)
            weight, block = np.repeat(weights, n), self.cell_block.take(cells)
            # a term has one cell in a block
            bound = np.bincount(block, weight * self.cell_max.take(cells), self.blocks) + np.maximum.reduceat(common, self.block_first)
            least = self._least(common if allowed is None else common * allowed)
            wanted = (bound >= least[self.block_label] - 1e-9) & (bound > 0)  # rounding may lower a bound a little
            use = wanted[block]
        if use is not None and np.count_nonzero(use) * MOST < len(cells):
            cells = cells[use]
            sims = self._lists(self.cell_first[cells], self.cell_first[cells + 1], weight[use]) + common * wanted[self.block_of]
        else:
            self.idle = IDLE if use is not None else self.idle - 1
            sims = self._lists(self.cell_first[a], self.cell_first[b], weights) + common
        if allowed is not None:
            sims *= allowed
        least = self._least(sims) - 1e-9
        who = np.concatenate([np.flatnonzero(sims[:self.zeros] >= least[0]), np.flatnonzero(sims[self.zeros:] >= least[1]) + self.zeros])
        who = who[sims[who] > 0]
        who = who[np.lexsort((self.ids[who], -np.round(sims[who], 12)))]
        y = self.labels[who]
        nth = np.where(y == 1, np.cumsum(y), np.cumsum(1 - y))
        who = who[nth <= NEIGHBOURS]
        return who, sims[who]

    def _least(self, sims: np.ndarray) -> np.ndarray:
        """The k-th best cosine of each label, 0 with fewer above 0."""
        return np.array([max(0.0, np.partition(s, -NEIGHBOURS)[-NEIGHBOURS]) if len(s) > NEIGHBOURS else 0.0 for s in (sims[:self.zeros], sims[self.zeros:])])

    def votes(self, vector, who: np.ndarray) -> np.ndarray:
        """Votes for label 1 and label 0, and the logarithm of their ratio."""
        total = np.zeros(2)
        if len(who):
            if self.dense is None:
                self.dense = np.zeros(int(self.say_of.max()) + 2)
            terms, weights = self.say_of[vector[0]], vector[1]
            self.dense[terms[terms >= 0]] = weights[terms >= 0]
            first = self.say_first[who]
            size = self.say_first[who + 1] - first
            at = _places(first, size)
            part = self.dense.take(self.say_terms.take(at))
            part *= self.say_weights.take(at)
            self.dense[terms[terms >= 0]] = 0
            total = np.bincount(np.repeat(self.labels[who], size), part, 2)
        return np.array([total[1], total[0], math.log((total[1] + 1e-4) / (total[0] + 1e-4))])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic fit of the examples' labels y on their votes x (each without itself)."""
        share = y.mean()
        weight = np.where(y == 1, self.rate / max(share, 1e-9), (1 - self.rate) / max(1 - share, 1e-9))
        a = np.column_stack([x, np.ones(len(x))])
        b = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(len(b))
            b += np.linalg.solve(h, a.T @ (weight * (y - p)) - 0.01 * b)
        self.beta = b

    def scores(self, texts: list, beta: np.ndarray):
        """(score, neighbours, cosines) of each text."""
        for vectors in self.vocabulary.vectors(texts):
            if not self.size:
                yield from ((0.0, np.zeros(0, np.int64), np.zeros(0)) for _ in vectors)
                continue
            for vector, common in zip(vectors, self.common(vectors)):
                who, sims = self.nearest(vector, common=common)
                x = float(self.votes(vector, who) @ beta[:-1] + beta[-1])
                yield 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), who, sims


def _term_counts(batches):
    """Partial (term, label) document counts, flushed before they grow large."""
    schema = pa.schema([("term", pa.string()), ("y", pa.int32()), ("n", pa.int64())])
    held: Counter = Counter()

    def out():
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], schema=schema)
    for b in batches:
        for text, y in zip(b.column("__text").to_pylist(), b.column("__y").to_pylist()):
            held.update((t.decode(), y) for t in set(words_of(text or "")))
            if len(held) > 300_000:
                yield out()
                held = Counter()
    if held:
        yield out()


def train(docs: DataFrame, labels: DataFrame, fold_ok, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          examples_per_class: int = EXAMPLES_PER_CLASS) -> Index:
    """An index of labelled rows that satisfy the condition ``fold_ok`` on the
    id; the document frequencies are those of all of ``docs``. What reaches the
    driver and the broadcasts is bounded by the texts of 2 * ``examples_per_class``
    examples."""
    spark = docs.sparkSession
    known = (labels.where(fold_ok).where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id"))
             .agg((F.max(label_col) > 0).cast("int").alias("__y")).withColumn("__h", F.xxhash64("__id")))
    chosen = C.lowest(known, "__y", ["__h", "__id"], examples_per_class)
    shares = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = shares.get(1, 0) / max(1, sum(shares.values()))
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    # at most 2 * examples_per_class ids; a row that repeats is one example
    examples = base.join(F.broadcast(chosen.select("__id", "__y")), "__id").select("__id", "__y", F.coalesce("__text", F.lit("")).alias("__text"))
    examples = C.cut(examples.withColumn("__th", F.xxhash64("__text")).dropDuplicates(["__id", "__th"]).drop("__th"))
    totals = {r["__y"]: r["n"] for r in examples.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    counts = examples.mapInArrow(_term_counts, "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).cast("double").alias("t1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).cast("double").alias("t0"))
    found = counts.toArrow().sort_by("term")
    terms = found.column("term").to_pylist()
    gain = label_gain(found.column("t1").to_numpy(), found.column("t0").to_numpy(), n1, n0)
    vocabulary = Vocabulary(terms, np.ones(len(terms)), gain)
    rows = []
    if terms or totals:
        words = spark.sparkContext.broadcast(vocabulary)

        def frequencies(batches):
            df, docs_seen = np.zeros(len(words.value.at), np.int64), 0
            for b in batches:
                texts = b.column("__text").to_pylist()
                docs_seen += len(texts)
                for some in pieces(texts):
                    df += np.bincount(words.value.count(some)[1], minlength=len(df))
            term = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(df[term], docs_seen))], names=["term", "n"])

        seen = base.select("__text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        at, n = seen.column("term").to_numpy(), seen.column("n").to_numpy()
        df = np.zeros(len(terms))
        df[at[at >= 0]] = n[at >= 0]
        vocabulary.idf = 1 + np.log((1 + float(n[at < 0].sum())) / (1 + df))

        def vectors(batches):
            for b in batches:
                got = words.value.counts(b.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__y"), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())],
                                                 names=["__id", "__y", "terms", "counts"])

        rows = sorted(tuple(r) for r in examples.mapInArrow(vectors, "__id long, __y int, terms binary, counts binary").collect())
        words.destroy()  # all that was made with it has been collected
    index = Index(vocabulary, [(i, y, *vocabulary.weigh(np.frombuffer(t, np.int32), np.frombuffer(n, np.int32))) for i, y, t, n in rows], rate)
    if index.size:
        known = index.broadcast(spark)

        def votes(batches):
            index = known.value
            for b in batches:
                got, ids = [], iter(b.column("__id").to_pylist())
                for vectors in index.vocabulary.vectors(b.column("__text").to_pylist()):
                    for vector, common in zip(vectors, index.common(vectors)):
                        got.append(index.votes(vector, index.nearest(vector, next(ids), common)[0]).tolist())
                yield pa.RecordBatch.from_arrays([b.column("__y"), pa.array(got, pa.list_(pa.float64()))], names=["y", "votes"])

        found = sorted(tuple(r) for r in examples.mapInArrow(votes, "y int, votes array<double>").collect())
        index.calibrate(np.array([f[1] for f in found]), np.array([f[0] for f in found], float))
    return index


def score_toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, score, predicted (1 if the score is
    at least 0.5) and evidence: the three nearest examples with their cosine
    and label."""
    shared, beta = index.broadcast(docs.sparkSession), index.beta
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    proof = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        index = shared.value
        for b in batches:
            score, evidence = [], []
            for s, who, sims in index.scores(b.column("__text").to_pylist(), beta):
                score.append(s)
                evidence.append([{"example": int(index.ids[w]), "cosine": float(c), "label": int(index.labels[w])} for w, c in zip(who[:3], sims[:3])])
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(evidence, proof)],
                                             names=["__id", "score", "predicted", "evidence"])
    return base.mapInArrow(run, "__id long, score double, predicted int, evidence array<struct<example: long, cosine: double, label: int>>").withColumnRenamed("__id", id_col)
