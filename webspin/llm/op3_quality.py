"""Quality classifier trained from overlapping heuristic labellers.

1. Ten labellers vote good, bad or nothing on every text (letters and digits,
   capitals, symbol runs, lone symbols, stop words, repeated words, variety,
   word length, sentence marks, symbols). The vote patterns of all documents are counted in one
   aggregation; there are at most 3**10 of them.
2. Expectation-maximisation over the pattern counts estimates how often each
   labeller votes what on good and on bad texts (its accuracies) and the share
   of good texts; each pattern gets the posterior of being good.
3. A linear scorer on hashed features (triples of byte classes, coded text
   statistics) learns the posteriors from a bounded sample
   (``sample_docs`` rows for each side of 0.5, lowest hashes first) and scores
   every text. A text is kept from a score of 0.5 on.

Defined cases: null and empty texts get no votes and the posterior of that
pattern; a table without rows scores nothing; if no text looks bad to any
labeller, everything is good; rows that repeat an id get a result each.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

SAMPLE_DOCS, DIMENSIONS, ROUNDS = 4000, 4096, 60
LABELLERS = ("letters", "capitals", "symbol_runs", "lone_symbols", "stop_words", "repeats", "variety", "word_length", "sentences", "symbols")
GOOD, BAD, NONE = 1, 0, 2
#: Byte classes: 0 letter, 1 capital, 2 digit, 3 sentence mark, 4 symbol, 5 space, 6 line end.
CLASS = np.full(256, 4, np.int64)
CLASS[list(range(97, 123)) + list(range(128, 256))] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
CLASS[list(b".,;:?!'\"()-")] = 3
CLASS[[32, 9, 11, 12]] = 5
CLASS[[10, 13]] = 6
STOP_WORDS = set(b"""the of and to in a is that it for on was with as are be this by from or an not have at
le la les de des du un une et en est que qui dans pour sur au aux avec par pas ce
der die das und ist von zu den mit auf im dem ein eine nicht sich
el los las y del al una es por con para se su lo como no""".split())


def statistics(raw: bytes, triples: np.ndarray) -> np.ndarray:
    """letters, capitals, symbol runs, lone symbols, stop words, repeats, variety,
    word length, sentence marks, symbols: shares; and the number of words."""
    words = raw.lower().split()
    n = len(words)
    t = triples.reshape(7, 7, 7)
    kinds = t.sum(axis=(0, 2)).astype(float)  # all bytes but the first and the last
    solid = max(1.0, kinds[:5].sum())
    pair = t.sum(axis=2)
    m = max(1, n)
    return np.array([
        (kinds[0] + kinds[1] + kinds[2]) / solid,
        kinds[1] / max(1.0, kinds[0] + kinds[1]),
        pair[3:5, 3:5].sum() / m,
        t[5:, 3:5, 5:].sum() / m,
        sum(w.strip(b".,;:?!'\"()-") in STOP_WORDS for w in words) / m,
        sum(map(eq, words, words[1:])) / m,
        len(set(words)) / m,
        sum(map(len, words)) / m,
        pair[3, 5:].sum() / m,
        kinds[4] / solid,
        n,
    ])


def votes(s: np.ndarray) -> tuple[int, ...]:
    """The labellers' votes on the statistics of a text."""
    def by(good: bool, bad: bool) -> int:
        return BAD if bad else GOOD if good else NONE
    n = s[10]
    if n == 0:
        return (NONE,) * len(LABELLERS)
    return (
        by(s[0] >= 0.9, s[0] < 0.78),
        by(s[1] <= 0.3, s[1] > 0.6 and n >= 5),
        by(s[2] <= 0.1, s[2] > 0.35),
        by(s[3] <= 0.05, s[3] > 0.25),
        by(s[4] >= 0.08, s[4] < 0.02 and n >= 40),
        by(s[5] <= 0.05, s[5] > 0.25 and n >= 5),
        by(s[6] >= 0.3, s[6] < 0.12 and 50 <= n <= 5000),
        by(2.5 <= s[7] <= 11, (s[7] < 1.8 or s[7] > 16) and n >= 5),
        by(1 / 60 <= s[8] <= 0.4, s[8] == 0 and n >= 60),
        by(s[9] <= 0.02, s[9] > 0.06),
    )


def profiles(data: np.ndarray, off: np.ndarray):
    """(statistics, byte class triples) of each row."""
    raw = data.tobytes()
    c = CLASS[data]
    t = c[:-2] * 49 + c[1:-1] * 7 + c[2:] if len(c) > 2 else np.zeros(0, np.int64)
    for a, b in zip(off[:-1], off[1:]):
        triples = np.bincount(t[a:max(a, b - 2)], minlength=343)
        yield statistics(raw[a:b], triples), triples


def features(s: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: (places, values)."""
    kinds = np.flatnonzero(triples)
    share = np.sqrt(triples[kinds] / max(1, triples.sum()))
    coded = [k * 64 + min(31, int(32 * min(1.0, x))) for k, x in enumerate(s[:7])] + [7 * 64 + min(31, int(s[7])), 8 * 64 + min(31, int(64 * s[8])), 9 * 64 + min(31, int(128 * s[9])), 10 * 64 + int(math.log2(1 + s[10]))]
    key = np.concatenate([kinds, 1000 + np.array(coded), [999]]).astype(np.uint64)
    place = (C.mix(key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % DIMENSIONS
    return place, np.concatenate([share, np.full(len(coded), 0.5), [1.0]])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation: the posterior of good for each vote pattern."""
    if not len(patterns):
        return np.zeros(0)
    onehot = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(float)  # no vote says nothing
    good = 1 / (1 + np.exp(-((patterns == GOOD).sum(axis=1) - 5.0 * (patterns == BAD).sum(axis=1))))
    # pseudo-texts, in proportion to the corpus: labellers seldom call a good text bad, and a
    # bad text need not look bad to most of them (junk comes in kinds that few labellers share)
    prior = {1: np.array([0.002, 0.998]) * counts.sum() / 2, 0: np.array([0.3, 0.7]) * counts.sum() / 20}
    for _ in range(rounds):
        logs = []
        for side, w in ((1, good * counts), (0, (1 - good) * counts)):
            table = np.einsum("p,plv->lv", w, onehot) + prior[side]
            table /= table.sum(axis=1, keepdims=True)
            logs.append(math.log(w.sum() + 10.0) + np.einsum("plv,lv->p", onehot, np.log(table)))
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return good


class Scorer:
    def __init__(self, posteriors: dict[int, float], weights: np.ndarray):
        self.posteriors, self.weights = posteriors, weights

    def score(self, s: np.ndarray, triples: np.ndarray) -> float:
        place, value = features(s, triples)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[place] @ value)))))


def _code(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def _decode(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def _votes(batches):
    for rows, data, off in C.text_pieces(batches, "__text"):
        yield pa.RecordBatch.from_arrays([rows.column("__h"), pa.array([_code(votes(s)) for s, _ in profiles(data, off)], pa.int32())], names=["__h", "pattern"])


def fit_linear(rows: list[tuple], steps: int = 300) -> np.ndarray:
    """Logistic regression on (places, values, target, weight) by accelerated
    gradient steps on the whole bounded sample."""
    w = np.zeros(DIMENSIONS)
    if not rows:
        return w
    place = np.concatenate([np.array(r[0], np.int64) for r in rows])
    value = np.concatenate([np.array(r[1], float) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    weight = np.array([r[3] for r in rows])
    weight = weight / weight.sum()
    seen, speed, rate = w.copy(), 1.0, 4.0 / max(1e-9, float((np.bincount(row, value ** 2) * weight).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * seen[place], len(y)), -30, 30)))
        g = np.bincount(place, value * (weight * (p - y))[row], DIMENSIONS) + 1e-5 * seen
        new = seen - rate * g
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        seen, w, speed = new + (speed - 1) / faster * (new - w), new, faster
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Scorer:
    spark = docs.sparkSession
    base = docs.select(F.xxhash64(id_col, text_col).alias("__h"), F.col(text_col).alias("__text"))
    seen = C.write_read(base.mapInArrow(_votes, "__h long, pattern int"), "votes")
    table = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    good = estimate(np.array([_decode(r["pattern"]) for r in table]), np.array([float(r["n"]) for r in table]))
    posteriors = {int(r["pattern"]): float(g) for r, g in zip(table, good)}
    if not posteriors:
        return Scorer({}, np.zeros(DIMENSIONS))
    known = spark.createDataFrame([(p, g) for p, g in posteriors.items()], "pattern int, posterior double")  # 3**10 rows at most
    side = seen.join(F.broadcast(known), "pattern").select("__h", "posterior", (F.col("posterior") >= 0.5).alias("side"))
    shares = {r["side"]: r["n"] for r in side.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = C.lowest(side, "side", ["__h"], sample_docs).dropDuplicates(["__h"])

    def learnable(batches):
        for rows, data, off in C.text_pieces(batches, "__text"):
            got = [features(s, t) for s, t in profiles(data, off)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64())), rows.column("posterior"), rows.column("side")],
                                             names=["places", "values", "posterior", "side"])

    rows = (base.join(F.broadcast(chosen.select("__h", "posterior", "side")), "__h").select("__h", "__text", "posterior", "side").dropDuplicates(["__h"])  # a row that repeats is one example
            .mapInArrow(learnable, "places array<long>, values array<double>, posterior double, side boolean").collect())
    rows = sorted(rows, key=lambda r: (r["posterior"], r["places"], r["values"]))
    taken = {k: sum(r["side"] == k for r in rows) for k in shares}
    return Scorer(posteriors, fit_linear([(r["places"], r["values"], r["posterior"], shares[r["side"]] / taken[r["side"]]) for r in rows]))


def score_quality(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, score (0 to 1, higher is better),
    predicted (1 if the score is at least 0.5), posterior and the votes (one
    digit per labeller: 1 good, 0 bad, 2 none)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))

    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__text"):
            score, posterior, said = [], [], []
            for s, t in profiles(data, off):
                v = votes(s)
                score.append(shared.value.score(s, t))
                posterior.append(shared.value.posteriors.get(_code(v)))
                said.append("".join(map(str, v)))
            yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array(score, pa.float64()), pa.array([int(x >= 0.5) for x in score], pa.int32()),
                                              pa.array(posterior, pa.float64()), pa.array(said, pa.string())], names=["__id", "score", "predicted", "posterior", "votes"])
    return base.mapInArrow(run, "__id long, score double, predicted int, posterior double, votes string").withColumnRenamed("__id", id_col)


def keep_good(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for rows, data, off in C.text_pieces(batches, text_col):
            yield rows.filter(pa.array([shared.value.score(s, t) >= 0.5 for s, t in profiles(data, off)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
