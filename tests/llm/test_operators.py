"""Operators of webspin.llm against brute force on small tables: plain rows,
nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names."""

import collections
import hashlib
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webspin.llm import common as C
from webspin.llm import (op1_language_id, op2_toxicity, op3_quality, op4_lm_score, op5_suffix_dedup, op6_html_text, op7_fingerprint, op8_decontaminate,
                         op9_near_dedup, op10_bpe)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, sig int, region string, token int, ids string"


def frame(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, "x", 1, "r", 2, "y") for i, t, lang in rows], SCHEMA)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.randint(60, 200)) for _ in range(25)]
    passage = words(rng, 60)
    out = [(i, t, "en") for i, t in enumerate(base)]
    out += [(100 + i, t + " " + passage + " " + words(rng, 20), "en") for i, t in enumerate(base[:6])]  # a shared passage
    out += [(200, base[0], "en"), (201, base[0], "en"), (201, base[0], "en")]  # copies and a repeated row
    near = base[1].split()
    near[10] = "changed"
    out += [(210, " ".join(near), "en")]
    near[40] = "again"
    out += [(211, " ".join(near).upper(), "en")]
    out += [(300, None, "en"), (301, "", None), (302, "  \n ", "en"), (303, "one two", "en"), (304, "One TWO", "en"), (305, "ñandú é " * 3, "es"), (None, "no id here " + base[3], "en")]
    out += [(400, "ab" * 2500, "en"), (401, words(rng, 8000), "en")]
    out += [(402, (words(rng, 70) + "\n") * 3, "de"), (403, "ü" * 700, "de")]
    return out


def spread_rows(spark, rows):
    return frame(spark, rows).repartition(5)


def brute_spans(texts, window):
    count = collections.Counter(b[i:i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i:i + window]] > 1:
                mark[i:i + window] = b"\1" * window
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("members", [20_000, 0])
def test_suffix_dedup_equals_brute_force(spark, rows, members, monkeypatch):
    monkeypatch.setattr(op5_suffix_dedup, "MEMBERS", members)  # 0: every core takes the distributed way
    got = op5_suffix_dedup.dedup_suffixes(spread_rows(spark, rows), window=120, core=40).collect()
    want = brute_spans([(t or "").encode() for _, t, _ in rows], 120)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r[0], *r[1:]) for r in got], key=key) == sorted([(i, *w) for (i, _, _), w in zip(rows, want)], key=key)


def test_suffix_dedup_in_one_long_text(spark):
    rng = random.Random(9)
    a, b = words(rng, 150_000), words(rng, 200)
    got = op5_suffix_dedup.dedup_suffixes(frame(spark, [(1, a + " " + b + " " + a[5000:9000] + b, "en"), (2, b, "en")])).collect()
    by = {r.doc_id: r for r in got}
    assert by[2].n_removed == by[2].n_bytes and by[1].n_spans == 3


def test_suffix_dedup_keeps_rows_and_columns(spark, rows):
    docs = spread_rows(spark, rows)
    out = op5_suffix_dedup.remove_repeats(docs, window=120, core=40)
    assert out.columns == docs.columns and out.count() == len(rows)
    by = {r.doc_id: r for r in out.collect()}
    assert by[300].text is None and by[300].n_chars is None and by[24].text == dict((i, t) for i, t, _ in rows)[24]
    assert all(r.n_chars == len(r.text) for r in by.values() if r.text is not None)


def brute_components(rows, percent):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            nameless = rows[i][0] is None or rows[j][0] is None  # such rows follow their class only
            if same or a and b and (a == b if nameless else 100 * len(a & b) >= percent * len(a | b)):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i))) for i, ((d, _, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block", [4096, 2])
def test_near_dedup_equals_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(op9_near_dedup, "BLOCK", block)  # 2: neighbourhoods are dealt out in sub-blocks
    got = op9_near_dedup.near_duplicates(spread_rows(spark, rows)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(brute_components(rows, 85), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_a_dense_group(spark):
    rng = random.Random(5)
    base, rows = words(rng, 150).split(), []
    for i in range(150):  # a chain of edits: ends of the chain are not alike
        base[rng.randrange(150)] = f"w{i}"
        rows.append((i, " ".join(base), "en"))
    got = {r.doc_id: r.component_id for r in op9_near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, 85)}


def test_near_dedup_proposes_links_across_a_large_region(spark, monkeypatch):
    monkeypatch.setattr(op9_near_dedup, "BLOCK", 64)
    rng, n, values = np.random.default_rng(2), 1400, op9_near_dedup.VALUES
    sig = rng.integers(0, 1 << 32, (n, values), dtype=np.uint32)
    sig[:, :op9_near_dedup.DEPTH] = 7  # all meet in the region of the first order
    for i in range(0, 200, 2):  # alike in 48 values, with no other region and not in the next value of this one
        own = np.arange(values) % op9_near_dedup.STEP == 0
        own[0], own[op9_near_dedup.DEPTH] = False, True
        sig[i + 1] = np.where(own, sig[i + 1], sig[i])
    # what the operator does with one region: dealt by task, then proposed
    ids = spark.createDataFrame([(0, i, n, bytearray(sig[i].tobytes())) for i in range(n)], "region long, cls long, size long, sig binary")
    t = op9_near_dedup._deal(ids, "region").select("task", "cls", "sig").orderBy("task", "cls").toArrow()
    assert max(collections.Counter(t.column("task").to_pylist()).values()) < 2 * 64  # no task holds the region
    got = {(r["a"], r["b"]) for b in op9_near_dedup._propose(44)(iter(t.to_batches(max_chunksize=500))) for r in b.to_pylist()}
    assert got == {(i, i + 1) for i in range(0, 200, 2)}


def test_near_dedup_goes_deeper_in_crowded_regions(spark, monkeypatch):
    monkeypatch.setattr(op9_near_dedup, "BLOCK", 64)
    rng, n, values = np.random.default_rng(6), 2000, op9_near_dedup.VALUES
    sig = rng.integers(0, 1 << 32, (n, values), dtype=np.uint32)
    shared = rng.random((n, values)) < 0.5  # boilerplate: a region of each order holds an eighth of all
    sig[shared] = np.broadcast_to(rng.integers(0, 1 << 32, values, dtype=np.uint32), sig.shape)[shared]
    for i in range(0, 400, 2):  # pairs at the threshold
        own = rng.random(values) < 0.15
        sig[i + 1] = np.where(own, sig[i + 1], sig[i])
    copy = sig[1000].copy()
    for i in range(1000, 1500):  # near copies crowd regions of every depth
        sig[i] = np.where(rng.random(values) < 0.05, sig[i], copy)
    nodes = spark.createDataFrame([(i, bytearray(sig[i].tobytes())) for i in range(n)], "cls long, sig binary").repartition(4)
    pairs = op9_near_dedup._neighbourhoods(nodes, 44)
    edges = [(r.a, r.b) for r in pairs.collect()]
    same = np.array([(sig == row).sum(axis=1) for row in sig])
    assert edges and all(same[a, b] >= 44 for a, b in edges)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        up[find(a)] = find(b)
    alike = [(int(a), int(b)) for a, b in np.argwhere(np.triu(same >= 44, 1))]
    assert len(alike) > 100_000 and all(find(a) == find(b) for a, b in alike)
    assert len(edges) < 40 * n  # a share of the pairs


def test_near_dedup_deals_a_joined_core_against_the_rest(spark, monkeypatch):
    monkeypatch.setattr(op9_near_dedup, "BLOCK", 64)
    rows = spark.createDataFrame([(0, i, 0 if i < 900 else i, 1000) for i in range(1000)], "region long, cls long, comp long, size long")
    dealt = [(r.task, r.cls) for r in op9_near_dedup._deal(op9_near_dedup._cored(rows, "region"), "region").select("task", "cls").collect()]
    tasks = collections.defaultdict(set)
    for task, cls in dealt:
        tasks[task].add(cls)
    met = {(a, b) for t in tasks.values() for a in t for b in t if a < b}
    assert all((a, b) in met for b in range(900, 1000) for a in range(b))  # the rest meets all
    assert max(map(len, tasks.values())) < 2 * 64 and len(dealt) < 900 * 5 + 100 * 40


def test_near_dedup_of_shared_boilerplate_by_sub_blocks(spark, monkeypatch):
    monkeypatch.setattr(op9_near_dedup, "BLOCK", 8)
    rng = random.Random(12)
    shared, rows = words(rng, 60), []
    for i in range(80):  # different texts of one template, each with a near copy
        own = words(rng, 40).split()
        rows += [(2 * i, shared + " " + " ".join(own), "en"), (2 * i + 1, shared + " " + " ".join(own[:-1] + ["edit"]), "en")]
    got = {r.doc_id: r.component_id for r in op9_near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, 85)} and len(set(got.values())) == 80


@pytest.mark.parametrize("percent, edits, agree", [(85, 4, 43), (80, 7, 40)])
def test_near_dedup_links_a_pair_of_unlike_signatures(spark, percent, edits, agree):
    rng = random.Random(4983)  # its signatures agree on fewer values than most pairs at the threshold
    one = [f"{rng.getrandbits(30):x}" for _ in range(120)]
    two = one[:60] + ["edit"] + one[61:-edits] + [f"{rng.getrandbits(30):x}" for _ in range(edits)]
    rows = [(1, " ".join(one), "en"), (2, " ".join(two), "en")]
    a, b = (op9_near_dedup.signature(op9_near_dedup.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0]) for _, t, _ in rows)
    assert (a == b).sum() == agree
    got = op9_near_dedup.near_duplicates(frame(spark, rows), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1}
    least, shared = op9_near_dedup._least(percent), 1 - (percent / 100) ** op9_near_dedup.DEPTH
    assert op9_near_dedup._below(least, percent / 100) < shared ** op9_near_dedup.ORDERS / 9


def test_links_by_blocks_and_by_pairs_agree():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(100, 300), replace=False)) for _ in range(60)] + [pool, pool[:-10]]
    want = np.array([[i != j and 100 * len(set(a) & set(b)) >= 70 * len(set(a) | set(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (op9_near_dedup._links(sets, 70) == want).all() and (op9_near_dedup._links(sets[-20:], 70) == want[-20:, -20:]).all()


def test_drop_near_duplicates_keeps_one_of_each_group(spark, rows):
    docs = spread_rows(spark, rows)
    out = op9_near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {0, 1, 24, 300, 301, None} <= set(ids) and not {200, 201, 210, 211} & set(ids)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate_equals_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(op8_decontaminate, "BLOCK", block)  # 3: many passes
    texts = {i: t for i, t, _ in rows}
    items = [(1, " ".join(texts[2].split()[5:30])), (2, "one, TWO!"), (3, None), (4, ""), (5, texts[4].upper()), (6, "nothing of this kind is in there at all, not even a bit"),
             (7, "é"), (None, " ".join(texts[7].split()[:12])), (2, "one, TWO!")]
    patterns = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            patterns[tuple(w[k:k + 10])].add(i)
    want = []
    for d, t, _ in rows:
        w = WORD.findall(low(t))
        hit, found = [0] * len(w), set()
        for p, owners in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit[k:k + len(p)] = [1] * len(p)
                    found |= owners
        names = sorted(str(x) for x in found if x is not None)
        want.append((d, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hits int")
    got = op8_decontaminate.decontaminate(spread_rows(spark, rows), table).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    kept = op8_decontaminate.drop_contaminated(spread_rows(spark, rows), table)
    assert kept.count() == sum(not w[-1] for w in want)


def test_fingerprints_of_neighbours(spark, rows):
    got = op7_fingerprint.edited_pairs(spread_rows(spark, rows)).collect()
    ordered = sorted(((i, t or "") if t is None else (i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    mark = lambda t: op7_fingerprint.digest(np.frombuffer(t.encode(), np.uint8))
    want = []
    for k, (i, t) in enumerate(ordered):
        follows = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + follows[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), mark(t), mark(edited), op7_fingerprint.likeness(mark(t), mark(edited)), op7_fingerprint.likeness(mark(t), mark(follows))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert op7_fingerprint.likeness(mark("a"), mark("a")) == 1 and len(mark("")) == len(mark("a" * 9))
    names = {r.doc_id: r.fingerprint for r in op7_fingerprint.fingerprints(spread_rows(spark, rows)).collect()}
    assert names[0] == names[200] == mark(rows[0][1])


def test_bpe_equals_the_tokenizer(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = [(500, "It's the world's <|endoftext|>end; don't  ΣΑΣ İ naïve é 1234 \x1c!!??", "en"), (501, "aaaa" * 500, "en"), (502, "thethethe inging", "en")]
    got = op10_bpe.digests(op10_bpe.encode_decode(spread_rows(spark, rows + extra))).collect()
    want = []
    for i, text, _ in rows + extra:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_bpe_words_of_many_merges():
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        codec = op10_bpe.Codec(json.load(f))
    t, rng = Tokenizer.from_file(path), random.Random(2)
    texts = ["".join(rng.choice(["the", "ing", "er", "an", "in", "re", "tion", "a", "h", "e", "é"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == e.ids, text


def test_lm_base_score_and_probabilities(spark, rows):
    docs = spread_rows(spark, rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    model, counts = op4_lm_score.train(docs.where(~held))
    got = op4_lm_score.score_texts(docs, held, model, counts).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    split = [(i, (t or "").encode().lower().split() + ["end"]) for i, t, _ in rows]
    count = collections.Counter(w for i, ws in split if not is_held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), is_held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in split)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # the probabilities of all words after one context add up to one
    symbol, place = np.array([3, 7, 0]), np.array([0, 1, 2])
    ctx = model.contexts(symbol, place)[:, 2:]
    total, classes = 0.0, np.exp(model.class_logs(ctx)[0])
    for g in range(op4_lm_score.HEAD // op4_lm_score.WIDTH):
        if np.isfinite(model.word_bias[g]).any():
            total += classes[g] * np.exp(model.word_logs(ctx, np.array([g]))[0]).sum()
    known = collections.Counter()
    for w, c in count.items():
        if w != "end" and w not in model.head:
            known[op4_lm_score.tail_class(w)] += c + 0.5
    for k in range(op4_lm_score.TAIL):
        total += classes[op4_lm_score.HEAD // op4_lm_score.WIDTH + k] * (known[k] + 0.5) / math.exp(model.tail_log[k])
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_keeps_what_one_task_learned(spark):
    rng = random.Random(21)
    texts = [["alpha beta " * 40] * 12] + [[words(rng, 80, "cdefg") for _ in range(12)] for _ in range(7)]
    docs = frame(spark, [(100 * k + i, t, "en") for k, part in enumerate(texts) for i, t in enumerate(part)])
    by = docs.withColumn("k", F.floor(F.col("doc_id") / 100).cast("int"))
    told = []
    for parts in (docs.coalesce(1), by.repartitionByRange(8, "k").drop("k")):
        model, _ = op4_lm_score.train(parts)
        rows = model.contexts(np.array([model.head[b"beta"], model.head[b"alpha"], 0]), np.array([0, 1, 2]))
        told.append(np.abs(model.weights[rows[2:, 2]]).sum())  # the two words before
    assert told[1] > 0.6 * told[0]  # averaged over all tasks it would be an eighth


def test_lm_learns_from_every_position(spark):
    docs = frame(spark, [(i, "one" if i % 2 else None, "en") for i in range(60)])  # texts of one word and of none
    model, _ = op4_lm_score.train(docs)
    rows = model.contexts(np.array([model.head[b"one"], 0]), np.array([0, 1]))
    assert np.abs(model.weights[rows]).sum(axis=2).all() and model.cells.any()
    # every position counts once per feature and round
    squares, touched = [np.zeros_like(model.weights), np.zeros_like(model.cells)], [np.zeros(op4_lm_score.ROWS), np.zeros(op4_lm_score.CELLS)]
    symbol, place = np.array([1, 0, 0, 1, 1, 0]), np.array([0, 1, 0, 0, 1, 2])
    model.learn(symbol, place, squares, touched)
    assert touched[0].sum() == 4 * len(symbol)


def test_lm_steps_are_those_of_plain_adagrad():
    rng = np.random.default_rng(4)
    counts = np.sort(rng.integers(1, 900, op4_lm_score.HEAD))[::-1].astype(float)
    model = op4_lm_score.Model({b"w%d" % i: i for i in range(1, op4_lm_score.HEAD)}, counts, int(counts.sum()), 3000, np.full(op4_lm_score.TAIL, 70.0), np.full(op4_lm_score.TAIL, 20.0))
    model.weights += rng.normal(0, 60, model.weights.shape).astype(np.float32)  # sums beyond what exponentials hold
    want, place = pickle.loads(pickle.dumps(model)), np.arange(900) % 300
    symbol = np.minimum(rng.zipf(1.3, 900) - 1, op4_lm_score.HEAD + op4_lm_score.TAIL - 1)
    squares, touched = [np.zeros_like(model.weights), np.zeros_like(model.cells)], [np.zeros(op4_lm_score.ROWS), np.zeros(op4_lm_score.CELLS)]
    model.learn(symbol, place, squares, touched)
    rows, (common, group) = want.contexts(symbol, place), op4_lm_score._classes(symbol)
    g = np.exp(want.class_logs(rows).astype(float))
    g[np.arange(900), group] -= 1
    total, cells = np.zeros(want.weights.shape), np.zeros(op4_lm_score.CELLS)
    for r in rows:
        np.add.at(total, r, g)
    k = np.flatnonzero(common)
    at = want.word_cells(rows[:, k], group[k])
    g = np.exp(want.word_logs(rows[:, k], group[k]).astype(float))
    g[np.arange(len(k)), symbol[k] % op4_lm_score.WIDTH] -= 1
    for c in at:
        np.add.at(cells, c, g)
    for sums, was, now, square in ((total, want.weights, model.weights, squares[0]), (cells, want.cells, model.cells, squares[1])):
        assert np.allclose(square, sums ** 2, rtol=1e-3, atol=1e-3) and np.allclose(now, was - op4_lm_score.RATE * sums / np.sqrt(sums ** 2 + 1), atol=1e-3)
    assert touched[0].sum() == 4 * 900


def test_lm_word_steps_keep_their_speed_after_a_broadcast():
    model = op4_lm_score.Model({}, np.ones(1), 1, 1, np.ones(op4_lm_score.TAIL), np.ones(op4_lm_score.TAIL))
    model = pickle.loads(pickle.dumps(model))
    seen, add = [], np.add

    class Spy:
        def __getattr__(self, name):
            return getattr(add, name)

        def __call__(self, *a, **k):
            return add(*a, **k)

        def at(self, x, index, y):
            seen.append((x.shape, getattr(y, "dtype", None)))
            add.at(x, index, y)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(np, "add", Spy())
        model.learn(np.zeros(8, np.int64), np.arange(8), [np.zeros_like(model.weights), np.zeros_like(model.cells)], [np.zeros(op4_lm_score.ROWS), np.zeros(op4_lm_score.CELLS)])
    values = [d for _, d in seen if d is not None]
    assert len(values) == 4 and all(d is np.dtype(np.float64) for d in values)


def test_lm_lists_a_word_once_per_block_and_sums_only_its_texts(spark):
    texts = [("head " * 700_000, i) for i in range(4)]  # 3.5 MB each: four pieces
    docs = spark.createDataFrame([(i, t + f"seldom{i % 2}") for t, i in texts], "__id long, __text string").withColumn("__held", F.lit(False)).coalesce(1)
    model = op4_lm_score.Model({b"head": 1}, np.array([4.0, 2_800_000]), 2_800_008, 4, np.ones(op4_lm_score.TAIL), np.ones(op4_lm_score.TAIL))
    got = docs.mapInArrow(op4_lm_score._score_blocks(spark.sparkContext.broadcast(model)), op4_lm_score.SCORED).where("ids is null").collect()
    assert sorted(bytes(r.token) for r in got) == [b"seldom0", b"seldom1"]  # one row each, whatever the pieces
    assert sorted(np.frombuffer(r.docs, np.int32).tolist() for r in got) == [[0, 2], [1, 3]]
    one = [(b"x", 7, np.array([5000], np.int32).tobytes(), None, np.array([3], np.int32).tobytes(), 9)]
    rows = spark.createDataFrame(one, "token binary, block long, docs binary, ids binary, n binary, c long").selectExpr(
        "token", "c", "block", "docs", "ids", "cast(null as binary) as known_n", "cast(null as binary) as held", "cast(null as binary) as part", "cast(null as binary) as base", "n")
    back = rows.mapInArrow(op4_lm_score._sum_words(), "block long, docs binary, ids binary, known_n binary, held binary, part binary, base binary, n binary").collect()
    assert len(back[0].part) == 8 and np.frombuffer(back[0].part, float)[0] == pytest.approx(3 * math.log(9.5))  # not 5,001 sums


def test_lm_tail_classes_of_whole_blocks():
    texts = ["a bc def ghij ünï é", "", "x"]
    raw = [t.encode() for t in texts]
    t = op4_lm_score.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    found = [t.low[a:a + n].tobytes() for a, n in zip(t.start.tolist(), t.size.tolist())]
    assert sorted(found) == sorted(b" ".join(raw).split()) and t.tails().tolist() == [op4_lm_score.tail_class(w) for w in found]


def test_language_models_learn_and_reject(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "xyzéß"}
    docs = [(i, words(rng, rng.randint(3, 60), alphabets[lang]), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    model = op1_language_id.train(frame(spark, docs + [(900, "no language", None), (901, None, "aa")]), "doc_id", "text", "lang")
    fresh = [(i, words(rng, 30, alphabets[lang]), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)] + [(800, None, "aa"), (801, "", "aa"), (802, "12 345!", "aa"), (803, "ЖЩЯЮ " * 30, "aa"), (None, "abcab", "aa")]
    got = {r.doc_id: r for r in op1_language_id.identify(frame(spark, fresh), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in fresh[:60])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (800, 801, 802))
    assert got[803].rejected and got[803].lang_pred in alphabets and all(0 <= r.score <= 1 for r in got.values())
    # every context's probabilities add up to one (over the letters and the unknown one)
    one = op1_language_id.Models(["aa"], model_counts([d for d in docs if d[2] == "aa"]))
    for ctx in ("    ", " abc", "edcb"):
        letters = sorted(set("abcde "))
        total = sum(math.exp(float(one.log_probs(np.array([ord(x) for x in ctx + c], np.uint32))[0, 0])) for c in letters)
        unseen = math.exp(float(one.log_probs(np.array([ord(x) for x in ctx + "q"], np.uint32))[0, 0]))
        assert total + unseen == pytest.approx(1, abs=1e-3)
    empty = op1_language_id.train(frame(spark, [(1, "abc", None)]), "doc_id", "text", "lang")
    assert [r.lang_pred for r in op1_language_id.identify(frame(spark, [(1, "abc", None)]), empty).collect()] == ["und"]


def model_counts(docs):
    import pandas as pd

    held = collections.Counter()
    for _, text, lang in docs:
        s = " " * (op1_language_id.ORDER - 2) + op1_language_id.symbols(text).tobytes().decode("utf-32-le")
        for i in range(len(s) - op1_language_id.ORDER + 1):
            held[lang, s[i:i + op1_language_id.ORDER]] += 1
    return pd.DataFrame([(a, b, n) for (a, b), n in held.items()], columns=["lang", "gram", "n"])


def toxic_rows():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        ws = words(rng, 40).split()
        if bad:
            ws[rng.randrange(40)] = rng.choice(["zzidiot", "zzmoron"])
        docs.append((i, " ".join(ws), "en"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def plain_cosines(docs, shown):
    """text -> {example id: cosine}: TF-IDF over all words of the examples, document frequencies over all docs."""
    find = lambda t: collections.Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    seen = set().union(*(find(t) for t in shown.values()))
    df = collections.Counter(w for _, t, _ in docs for w in find(t) if w in seen)

    def vector(t):
        v = {w: (1 + math.log(n)) * (1 + math.log((1 + len(docs)) / (1 + df[w]))) for w, n in find(t).items() if w in seen}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}
    known = {i: vector(t) for i, t in shown.items()}

    def cosines(text):
        v = vector(text)
        return {i: sum(x * e.get(w, 0) for w, x in v.items()) for i, e in known.items()}
    return cosines


@pytest.mark.parametrize("block", [64, 4])
def test_toxicity_finds_exactly_the_nearest_and_scores(spark, block, monkeypatch):
    monkeypatch.setattr(op2_toxicity, "BLOCK", block)
    docs, labels = toxic_rows()
    docs = docs + [docs[0], (900, "\u00c9t\u00e9 caf\u00e9, " + "lang" * 30, "fr")]
    table = spark.createDataFrame(labels + [(0, 1, 1), (5, 1, None), (7777, 1, 1), (900, 1, 0)], "doc_id long, quality int, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    index = op2_toxicity.train(frame(spark, docs), table, fold)
    texts, toxic = {i: t for i, t, _ in docs}, {i: y for i, _, y in labels} | {900: 0}
    shown = {int(i): texts[int(i)] for i in index.ids}
    assert sorted(shown) == sorted(i for i in toxic if zlib.crc32(str(i).encode()) % 5)
    cosines = plain_cosines(docs, shown)
    rng = random.Random(6)
    probes = [docs[rng.randrange(300)][1] + " " + words(rng, 10) for _ in range(40)] + [t for t in shown.values()][:20]
    for text in probes:
        want = cosines(text)
        best = []
        for y in (0, 1):
            best += sorted((i for i in want if toxic[i] == y and want[i] > 0), key=lambda i: (-round(want[i], 12), i))[:op2_toxicity.NEIGHBOURS]
        who, sims = index.nearest(index.vocabulary.vector(text))
        got = {int(index.ids[w]): s for w, s in zip(who, sims)}
        assert sorted(got) == sorted(best) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        assert list(sims) == sorted(sims, reverse=True)
    for i in list(shown)[:20]:
        who, sims = index.nearest(index.vocabulary.vector(shown[i]))
        assert abs(sims[0] - 1) < 1e-9 and i in index.ids[who]
    extra = [(800, None, None), (801, "", "en"), (None, "zzidiot", "en")]
    got = {r.doc_id: r for r in op2_toxicity.score_toxicity(frame(spark, docs + extra), index).collect()}
    right = sum(got[i].predicted == y for i, _, y in labels)
    assert right >= 0.97 * len(labels) and got[800].score == got[801].score < 0.5 and got[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_with_examples_of_one_label(spark):
    docs, labels = toxic_rows()
    table = spark.createDataFrame([r for r in labels if not r[2]], "doc_id long, quality int, toxic int")
    index = op2_toxicity.train(frame(spark, docs), table, F.lit(True))
    assert all(r.predicted == 0 for r in op2_toxicity.score_toxicity(frame(spark, docs), index).collect())


@pytest.mark.parametrize("most", [1, 10**9])
def test_toxicity_reads_lists_once_and_leaves_out_blocks(monkeypatch, most):
    monkeypatch.setattr(op2_toxicity, "MOST", most)
    rng = random.Random(5)
    some = words(rng, 100).split()
    texts = [f"{'the' if i < 640 else 'le'} " * 9 + " ".join(rng.sample(some, 3)) + " only" + words(rng, 1) * 3 for i in range(1280)]
    terms = sorted({w for t in texts for w in t.split()})
    vocabulary = op2_toxicity.Vocabulary(terms, np.array([0.9 if t in ("the", "le") else 1.0 for t in terms]), np.ones(len(terms)))
    index = op2_toxicity.Index(vocabulary, [(i, i % 2, *vocabulary.vector(t)) for i, t in enumerate(texts)], 0.5)
    calls, lists = [], index._lists
    monkeypatch.setattr(index, "_lists", lambda first, last, weights: calls.append((last - first).sum()) or lists(first, last, weights))
    found = list(index.scores(texts[:70], index.beta))
    assert len(calls) == 70 and [int(index.ids[who[0]]) for _, who, _ in found] == list(range(70))
    whole = 0
    for t in texts[:70]:
        at = vocabulary.vector(t)[0]
        at = at[index.row_of[at] < 0]
        whole += int((index.cell_first[index.term_first[at + 1]] - index.cell_first[index.term_first[at]]).sum())
    assert len(index.cell_max) == len(set(zip(np.repeat(np.arange(len(terms)), np.diff(index.term_first)).tolist(), index.cell_block.tolist())))
    assert sum(calls) < 0.7 * whole if most == 1 else sum(calls) == whole  # blocks of the other language are out


def test_toxicity_words_are_runs_of_letters():
    ascii_text, any_text = "".join(map(chr, range(128))) + " Ab_c9D-e", "".join(chr(i) + "a" for i in range(128, 0xD800)) + "\u212a x"
    for t in (ascii_text, any_text, ""):
        assert [w.decode() for w in op2_toxicity.words_of(t)] == re.findall(r"[^\W\d_]+", t.lower())


def test_quality_learns_from_votes_alone(spark):
    rng = random.Random(11)
    good = [(i, ". ".join("The " + words(rng, 9) + " and the " + words(rng, 3) for _ in range(6)) + ".", "en") for i in range(150)]
    loud = [(200 + i, words(rng, 60).upper().replace(" ", "!! "), "en") for i in range(12)]
    odd = [(300 + i, words(rng, 60).replace(" ", "%%% "), "en") for i in range(12)]
    same = [(400 + i, ("Word " * 40 + "other " * 40).strip(), "en") for i in range(12)]
    docs = frame(spark, good + loud + odd + same + [(500, None, "en"), (501, "", "en"), (502, "Short one.", "en")]).repartition(4)
    scorer = op3_quality.train(docs)
    got = {r.doc_id: r for r in op3_quality.score_quality(docs, scorer).collect()}
    assert all(got[i].predicted == 1 for i, _, _ in good) and got[502].predicted == 1
    assert sum(got[i].predicted == 0 for i, _, _ in loud + odd + same) >= 34
    kept = op3_quality.keep_good(docs, scorer)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op5_suffix_dedup.dedup_suffixes(none).count() == op9_near_dedup.near_duplicates(none).count() == 0
    assert op8_decontaminate.decontaminate(none, items).count() == op7_fingerprint.edited_pairs(none).count() == op10_bpe.encode_decode(none).count() == 0
    model, counts = op4_lm_score.train(none)
    assert op4_lm_score.score_texts(none, F.lit(True), model, counts).count() == 0
    scored = op4_lm_score.score_texts(frame(spark, [(1, "a b", "en")]), F.lit(True), model, counts).collect()
    assert scored[0].n_known == 0 and scored[0].train_tokens == 0 and math.isfinite(scored[0].score)
    assert op3_quality.score_quality(none, op3_quality.train(none)).count() == 0
    index = op2_toxicity.train(none, labels, F.lit(True))
    assert [r.score for r in op2_toxicity.score_toxicity(frame(spark, [(1, "a", "en")]), index).collect()] == [0.0]
    assert op1_language_id.identify(none, op1_language_id.train(none, "doc_id", "text", "lang")).count() == 0
    assert op6_html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;paragraph,\n with   <a href=x>a link</a>.<br><p>Second<br>line</p><div class="ad">Buy now</div>
<p>Third &lt;tag&gt; &#233;&copy;</p><form><input><p>Mail</p></form><aside>Side</aside></article>
<section id="comments"><p>Nice text of a reader.</p></section><footer>c</footer></body></html>"""


def test_html_main_text(spark):
    got = op6_html_text.main_text(PAGE)
    assert got == "Title & more\nFirst paragraph, with a link.\nSecond line\nThird <tag> é©"
    for n in (1900, 2100, 60_000):  # what stays open around a block is not forgotten
        menu = "<nav>" + "<b>" * n + "Home menu words here</nav><p>Kept</p>"
        assert op6_html_text.main_text("<article>" + menu + "</article>") == "Kept", n
    long = "The house of the man was in the town and he said that it is for the people of the land to see it. " * 3
    plain = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><h2>Head</h2><p>{long}</p><p>Short.</p><p>{long}</p><div><a href=3>More links to other pages here and there</a></div>"
    assert op6_html_text.main_text(plain) == f"Head\n{long.strip()}\nShort.\n{long.strip()}"
    rows = [(1, "u", PAGE), (2, "u", None), (2, "u", ""), (3, None, "<p"), (4, "u", "<b>" * 50_000 + "x"), (5, "u", "<!-- never closed " * 9), (6, "u", "a &am"), (None, "u", "<p>a<p>b")]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, text string")
    got = op6_html_text.extract(pages).collect()
    assert sorted((str(r.page_id), r.text if len(r.text) < 20 else len(r.text), r.n_chars == len(r.text)) for r in got) == sorted(
        [("1", len(op6_html_text.main_text(PAGE)), True), ("2", "", True), ("2", "", True), ("3", "", True), ("4", "x", True), ("5", "", True), ("6", "a &am", True), ("None", "a\nb", True)], key=lambda r: r)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(500, 400), (450, 400)]
    got = {r.node: r.comp for r in op9_near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}, 400: 400, 450: 400, 500: 400}


def test_spans_and_words():
    data = np.frombuffer(b"ab cdab", np.uint8)
    start, end, row = C.word_spans(data, np.array([0, 5, 5, 7]), op9_near_dedup.SPACE)
    assert list(zip(start, end, row)) == [(0, 2, 0), (3, 5, 0), (5, 7, 2)]
    p = C.prefix_hash(data)
    assert C.span_hash(p, np.array([0]), np.array([2]))[0] == C.span_hash(p, np.array([5]), np.array([7]))[0] != C.span_hash(p, np.array([3]), np.array([5]))[0]


def test_lowest_rows_of_a_hot_value(spark):
    rows = spark.range(5000).select((F.col("id") % 10 == 0).alias("y"), F.xxhash64("id").alias("h"), "id")
    got = {(r.y, r.id) for r in C.lowest(rows, "y", ["h", "id"], 30, slices=7).collect()}
    want = set()
    for y in (True, False):
        want |= {(y, r.id) for r in rows.where(F.col("y") == y).orderBy("h", "id").limit(30).collect()}
    assert got == want


def test_fingerprints_over_thousands_of_partitions(spark):
    """One bucket per id, so that every document is a guest of another one."""
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id")).alias("text"))
        plan = op7_fingerprint.edited_pairs(docs)
        assert len(plan._jdf.queryExecution().analyzed().toString()) < 500_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
