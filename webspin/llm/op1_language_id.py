"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased, everything but letters becomes one blank, and each
language gets a character model of order 5: absolute discounts per order,
continuation counts below the highest order, interpolated down to a uniform
floor over the alphabet. The models of all languages share one sorted array of
n-gram hashes per order, with one column of log probabilities per language for
n-grams and one of log back-off weights for contexts; an n-gram that a
language never saw has its backed-off probability filled in, so that one look
at the longest known n-gram scores all languages.

The language with the lowest cross-entropy per character wins. ``score`` is a
calibrated confidence: a logistic function of the margin to the second best
language, fitted on a slice of the training rows that the counts left out. A
text whose cross-entropy lies above its language's limit (the 99.9th
percentile of that slice plus a tenth) is marked ``rejected``.

Learning takes ``sample_docs`` rows per language at most (those with the
lowest hash of the id), whole texts; this bounds the model that is broadcast.

Defined cases: texts that are null or hold no letter are ``und`` with score 0;
a training set without any language predicts ``und`` everywhere; ties go to
the language that sorts first; rows that repeat an id get a result each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

ORDER = 5
#: Learning rows per language, and the share of them kept for calibration.
SAMPLE_DOCS, CALIBRATION = 1500, 5
UNKNOWN = "und"
BLANK = 32
LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not LETTER[ord("a")]:
        for start in range(0, 0x110000, 4096):
            LETTER[start:start + 4096] = [chr(c).isalpha() for c in range(start, start + 4096)]
    return LETTER


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points; other runs are one blank; a blank on
    both sides. Empty if there is no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.uint32)
    cp = np.where(letter, cp, BLANK)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != BLANK) | (cp[:-1] != BLANK)
    cp = cp[keep]
    first, last = cp[:1] == BLANK, cp[-1:] == BLANK
    return np.concatenate([[BLANK]] * (not first[0]) + [cp] + [[BLANK]] * (not last[0])).astype(np.uint32)


#: Odd factors of the places in an n-gram.
PLACE = np.random.default_rng(5).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def spread(cp: np.ndarray) -> np.ndarray:
    return C.mix(cp.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class SortedHashes:
    """Sorted hashes with a row of values each; the top bits of a hash lead
    to the few entries that share them."""

    def __init__(self, grams: list[str], rows: np.ndarray):
        n = len(grams[0]) if grams else 0
        cp = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), n) if n else np.zeros((len(grams), 0), np.uint32)
        h = np.full(len(grams), n, np.uint64)
        for k in range(n):
            h += spread(cp[:, k]) * PLACE[k]
        h = C.mix(h)
        order = np.argsort(h)
        self.keys, self.rows = h[order], rows[order].astype(np.float32)
        bits = max(1, len(grams).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        self.first = np.append(self.first, len(grams))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if it isn't there."""
        top = (h >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1)
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.keys[at[left]] == h[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class Models:
    """langs; per order n: n-grams with log probabilities and contexts with
    log back-off weights, one column per language."""

    def __init__(self, langs: list[str], counts: pd.DataFrame):
        """counts: lang, gram (string of ORDER symbols), n."""
        self.langs = langs
        self.grams: list[SortedHashes] = []
        self.contexts: list[SortedHashes] = []
        self.floor = -math.log(len({c for g in counts["gram"] for c in g}) + 1)
        tables = [self._one(counts[counts["lang"] == lang]) for lang in langs]
        lower, lower_at = np.full((1, len(langs)), self.floor), {"": 0}
        for n in range(1, ORDER + 1):
            at = {g: i for i, g in enumerate(sorted({g for t in tables for g in t[n][0]}))}
            ctx = {g: i for i, g in enumerate(sorted({g for t in tables for g in t[n][1]}))}
            share, weight = np.zeros((len(at), len(langs))), np.ones((len(ctx), len(langs)))
            for k, t in enumerate(tables):
                share[[at[g] for g in t[n][0]], k] = list(t[n][0].values())
                weight[[ctx[g] for g in t[n][1]], k] = list(t[n][1].values())
            # the end of an n-gram is a shorter n-gram of the same language, so that it is known
            rows = np.log(share + weight[[ctx[g[:-1]] for g in at]] * np.exp(lower[[lower_at[g[1:]] for g in at]]))
            self.grams.append(SortedHashes(list(at), rows))
            self.contexts.append(SortedHashes(list(ctx), np.log(weight)))
            lower, lower_at = rows, at
        self.scale, self.offset = 1.0, 0.0
        self.limit = np.full(len(langs), np.inf)

    @staticmethod
    def _one(counts: pd.DataFrame) -> list:
        """Per order: discounted shares of n-grams, and back-off weights of contexts."""
        out: list = [None] * (ORDER + 1)
        table = dict(zip(counts["gram"], counts["n"].astype(float)))
        for n in range(ORDER, 0, -1):
            ones = sum(1 for v in table.values() if v == 1)
            twos = sum(1 for v in table.values() if v == 2)
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
            total: dict[str, float] = {}
            kinds: dict[str, int] = {}
            for g, v in table.items():
                total[g[:-1]] = total.get(g[:-1], 0.0) + v
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            out[n] = ({g: (v - discount) / total[g[:-1]] for g, v in table.items()}, {c: discount * kinds[c] / total[c] for c in total})
            below: dict[str, float] = {}  # continuation counts: distinct letters before the shorter n-gram
            for g in table:
                below[g[1:]] = below.get(g[1:], 0.0) + 1
            table = below
        return out

    def log_probs(self, cp: np.ndarray) -> np.ndarray:
        """Log probability of each symbol from place ORDER - 1 on, one column per language."""
        v = spread(cp)
        m = len(cp) - ORDER + 1
        out = np.zeros((m, len(self.langs)), np.float32)
        todo = None  # None: all places
        for n in range(ORDER, 0, -1):
            grams, contexts = self.grams[n - 1], self.contexts[n - 1]
            parts = [v[ORDER - n + k:ORDER - n + k + m] if todo is None else v[todo + ORDER - n + k] for k in range(n)]
            h = np.full(len(parts[0]), n - 1, np.uint64)
            for k in range(n - 1):
                h += parts[k] * PLACE[k]
            row = grams.find(C.mix(h + np.uint64(1) + parts[n - 1] * PLACE[n - 1]))
            hit = row >= 0
            if todo is None:
                todo = np.arange(m)
            out[todo[hit]] += grams.rows[row[hit]]
            todo, h = todo[~hit], h[~hit]
            if not len(todo):
                break
            c = contexts.find(C.mix(h))
            out[todo[c >= 0]] += contexts.rows[c[c >= 0]]
        else:
            out[todo] += np.float32(self.floor)
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character (nats) by text and language; nan without letters."""
        pad = np.full(ORDER - 2, BLANK, np.uint32)  # the first letter's context: blanks
        parts = [symbols(t) for t in texts]
        out = np.full((len(texts), len(self.langs)), np.nan)
        real = [i for i, p in enumerate(parts) if len(p)]
        if real and self.langs:
            cp = np.concatenate([x for i in real for x in (pad, parts[i])])
            lens = np.array([len(parts[i]) + len(pad) for i in real])
            start = np.cumsum(lens) - lens
            logs = np.zeros((len(cp), len(self.langs)))
            step = 1 << 18
            for at in range(ORDER - 1, len(cp), step):
                logs[at:at + step] = self.log_probs(cp[at - ORDER + 1:at + step])
            for k in range(ORDER - 1):
                logs[start + k] = 0
            out[real] = -np.add.reduceat(logs, start, axis=0) / (lens - ORDER + 1)[:, None]
        return out

    def predict(self, texts: list[str]):
        """(language, score, cross-entropy, rejected) of each text."""
        e = self.entropies(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        none = np.isnan(e[:, 0])
        filled = np.where(none[:, None], 0, e)
        best = filled.argmin(axis=1)
        lowest = filled[np.arange(len(e)), best]
        margin = (np.sort(filled, axis=1)[:, 1] - lowest) if len(self.langs) > 1 else np.full(len(e), 1.0)
        score = 1 / (1 + np.exp(-np.clip(self.scale * margin + self.offset, -30, 30)))
        langs = [UNKNOWN if n else self.langs[b] for n, b in zip(none, best)]
        return langs, np.where(none, 0.0, score), np.where(none, np.nan, lowest), none | (lowest > self.limit[best])

    def calibrate(self, margins: np.ndarray, right: np.ndarray) -> None:
        """Logistic fit of being right on the margin (Newton steps, small ridge
        and one pseudo-row of each outcome, so that it always converges)."""
        x = np.concatenate([margins, [0.0, 0.0]])
        y = np.concatenate([right.astype(float), [0.0, 1.0]])
        unit = max(1e-6, float(np.median(margins))) if len(margins) else 1.0
        b = np.zeros(2)
        a = np.stack([x / unit, np.ones(len(x))], axis=1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
            b += np.linalg.solve(h, a.T @ (y - p) - 0.1 * b)
        self.scale, self.offset = float(max(0.0, b[0]) / unit), float(b[1])


def _count_grams(batches):
    """Partial n-gram counts, flushed before they grow large."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    held: dict = {}

    def out():
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                           pa.array([held[k] for k in keys], pa.int64())], schema=schema)
    for b in batches:
        for lang, text in zip(b.column("__lang").to_pylist(), b.column("__text").to_pylist()):
            cp = symbols(text or "")
            s = cp.tobytes().decode("utf-32-le", "surrogatepass")
            s = " " * (ORDER - 2) + s  # the first symbol has a full context of blanks
            for i in range(len(s) - ORDER + 1 if len(cp) else 0):
                key = (lang, s[i:i + ORDER])
                held[key] = held.get(key, 0) + 1
            if len(held) > 200_000:
                yield out()
                held = {}
    if held:
        yield out()


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models of the languages in ``docs`` (rows with a null language or
    text are no examples)."""
    spark = docs.sparkSession
    base = docs.select(F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), F.xxhash64(id_col).alias("__h")).where("__lang is not null and __text is not null")
    # the rows with the lowest hashes of each language
    chosen = C.lowest(base.select("__lang", "__h"), "__lang", ["__h"], sample_docs)
    limits = {r["__lang"]: r["top"] for r in chosen.groupBy("__lang").agg(F.max("__h").alias("top")).collect()}
    if not limits:
        return Models([], pd.DataFrame({"lang": [], "gram": [], "n": []}))
    keep = F.lit(False)
    for lang, top in limits.items():
        keep = keep | ((F.col("__lang") == lang) & (F.col("__h") <= F.lit(top)))
    sample = base.where(keep)
    held_back = F.pmod(F.xxhash64("__h"), F.lit(CALIBRATION)) == 0
    counts = (sample.where(~held_back).select("__lang", "__text").mapInArrow(_count_grams, "lang string, gram string, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    models = Models(sorted(set(counts["lang"])), counts)
    shared = spark.sparkContext.broadcast(models)

    def margins(batches):
        for b in batches:
            e = shared.value.entropies([t or "" for t in b.column("__text").to_pylist()])
            best = np.where(np.isnan(e[:, 0]), -1, np.argmin(np.where(np.isnan(e), np.inf, e), axis=1))
            top2 = np.sort(e, axis=1)
            names = shared.value.langs
            yield pa.RecordBatch.from_arrays([pa.array([names[i] if i >= 0 else None for i in best], pa.string()), b.column("__lang"),
                                              pa.array(top2[:, 1] - top2[:, 0] if len(names) > 1 else np.ones(len(e))), pa.array(top2[:, 0])],
                                             names=["best", "lang", "margin", "low"])

    seen = sample.where(held_back).select("__lang", "__text").mapInArrow(margins, "best string, lang string, margin double, low double").where("best is not null").toPandas()
    if len(seen):
        right = (seen["best"] == seen["lang"]).to_numpy()
        models.calibrate(seen["margin"].to_numpy(), right)
        for i, lang in enumerate(models.langs):
            own = seen["low"][(seen["best"] == lang) & right]
            if len(own):
                models.limit[i] = own.quantile(0.999) * 1.1
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, lang_pred, score, cross_entropy
    (per character, null without letters) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))

    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__text", 1 << 19):
            raw = data.tobytes()
            texts = [raw[off[i]:off[i + 1]].decode("utf-8", "replace") for i in range(rows.num_rows)]
            langs, score, low, rejected = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(low, pa.float64(), from_pandas=True), pa.array(rejected, pa.bool_())],
                                             names=["__id", "lang_pred", "score", "cross_entropy", "rejected"])
    return base.mapInArrow(run, "__id long, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("__id", id_col)
