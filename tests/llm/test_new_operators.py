"""Token files, spelling variants and hard negatives against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webspin.llm import common as C
from webspin.llm import op11_token_files as T
from webspin.llm import op12_spelling as S
from webspin.llm import op13_hard_negatives as N

DOCS = "doc_id long, text string, word string, n long, ids string, key int"


def docs_frame(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], DOCS)


def prose(rng, n, letters="abcdeé"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 300))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "It's DON'T we'LL 's ,'s 12ab ÀÉß ×÷ <|endoftext|> a<|startoftext|>"), (74, "日本語 テスト\x1cx ﬁ Ǆ İ"), (75, "😀 a​b")]
    rows += [(76, rows[3][1]), (76, rows[3][1]), (76, "other text"), (None, "no id"), (None, None), (77, "x" * 5000), (-5, prose(rng, 9000))]
    return rows


# -- 11 ----------------------------------------------------------------------------------

def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_token_files_round_trip(spark, texts, tmp_path):
    path = f"file://{tmp_path}/tokens"
    T.write_tokens(docs_frame(spark, texts).repartition(5), path)
    t = library()
    got = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in T.read_tokens(spark, path).collect()]
    got.sort(key=lambda r: r[1])
    want = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in texts)
    assert collections.Counter((i, tuple(ids)) for i, _, _, ids in got) == want
    assert [g[0] for g in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    crc = {r.start: r.ids_crc32 for r in T.digests(T.read_tokens(spark, path)).collect()}
    assert all(crc[s] == zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, _, ids in got)
    few = T.read_tokens(spark, path, ids=[76, 5, 9999]).collect()
    assert sorted((r.doc_id, r.start) for r in few) == sorted((i, s) for i, s, _, _ in got if i in (76, 5))


def test_token_files_name_their_dictionary(spark, texts, tmp_path):
    import json

    path = f"{tmp_path}/tokens"
    name = T.write_tokens(docs_frame(spark, texts), f"file://{path}")
    manifest = json.load(open(f"{path}/manifest.json"))
    assert manifest["dictionary"] == name and sum(s["rows"] for s in manifest["shards"]) == len(texts)
    shard = f"{path}/{manifest['shards'][0]['name']}"
    raw = bytearray(open(shard, "rb").read())
    raw[10] ^= 1  # another dictionary's shard is refused
    open(shard, "wb").write(raw)
    with pytest.raises(Exception, match="not a token shard"):
        T.read_tokens(spark, f"file://{path}").collect()
    open(f"{path}/shard-000000-lost.ztok", "wb").write(b"left by a lost attempt")
    raw[10] ^= 1
    open(shard, "wb").write(raw)
    assert T.read_tokens(spark, f"file://{path}").count() == len(texts)


def test_token_files_of_no_documents(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    T.write_tokens(docs_frame(spark, []), path)
    assert T.read_tokens(spark, path).count() == 0 and T.read_tokens(spark, path, ids=[1]).count() == 0


@pytest.mark.parametrize("memo", [500_000, 300])
def test_encoder_equals_the_library(memo, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(T, "MEMO", memo)
    monkeypatch.setattr(T, "LONG", 40)
    e, t, rng = T.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()), library(), random.Random(1)
    for _ in range(60):
        batch = ["".join(rng.choice("ab's1, T<|RVELMDÉß\n×\x01 日") for _ in range(rng.randint(0, 60))) for _ in range(50)]
        batch += ["".join(rng.choice("ab's1, TRVELMDÉß") for _ in range(rng.randint(0, 90))) for _ in range(50)]
        data, off = C.string_view(pa.array(batch, pa.string()))
        assert [x.tolist() for x in e.encode(data, off)] == [list(x.ids) for x in t.encode_batch_fast(batch, add_special_tokens=False)]


# -- 12 ----------------------------------------------------------------------------------

def one_edit(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    x, y = sorted((x, y), key=len)
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + 1:] == y[i + 1:] if len(x) == len(y) else x[i:] == y[i + 1:]


def brute_variants(count, least=5, factor=2):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= factor * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out


def brute_words(rows):
    count = collections.Counter()
    lower = {65 + i: 97 + i for i in range(26)}
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 3}


@pytest.mark.parametrize("limit", [4096, 3])
def test_spelling_variants_equal_brute_force(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(S, "LIMIT", limit)
    monkeypatch.setattr(S, "HELD", 50)
    monkeypatch.setattr(S, "PIECE", 100)
    rng = random.Random(8)
    rows = texts + [(200 + i, " ".join("".join(rng.choice("abÉ") for _ in range(rng.randint(4, 7))) for _ in range(900))) for i in range(8)]
    rows += [(300, "Ärger ärger ÄRGER ×÷×÷× ×÷×÷× ×÷×÷×"), (301, " ".join(["q" * 700] * 4 + ["q" * 701] * 9 + ["q" * 350 + "r" + "q" * 350] * 20))]
    words = brute_words(rows)
    want = brute_variants(words)
    got = {r.word: tuple(r) for r in S.spelling_variants(docs_frame(spark, rows).repartition(4)).collect()}
    assert got == want and any(w[1] for w in want.values()) and max(w[4] for w in want.values()) > 5


def test_spelling_chains_and_nothing(spark):
    words = [("abcdefgh"[:5] + "x" * i, 3 * 2 ** i) for i in range(9)] + [("zzzzz", 5), ("zzzzy", 9)]
    got = {r.word: (r.form, r.root, r.n_near) for r in S.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcde"] == ("abcdex", "abcde" + "x" * 8, 1) and got["abcdex"][2] == 2
    assert got["zzzzz"] == (None, "zzzzz", 1)  # 9 is less than twice 5
    assert S.spelling_variants(docs_frame(spark, [])).count() == 0
    assert S.spelling_variants(docs_frame(spark, [(1, None), (2, "")])).count() == 0


def test_scan_skips_and_reuses_rows():
    words = sorted({"".join(x) for x in np.random.default_rng(2).choice(list("abc"), (400, 6))} | {"".join(x) for x in np.random.default_rng(3).choice(list("abc"), (300, 5))})
    size = np.array([len(w) for w in words])
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(size) - size
    group = np.zeros(len(words), np.int64)
    lcp = S._adjacent_lcp(chars, start, size, group)
    n = len(words)
    x, y, shared = S.scan(chars, start, size, lcp, np.arange(n - 1), np.full(n - 1, n - 1))
    assert {(words[a], words[b]) for a, b in zip(x, y)} == {(a, b) for i, a in enumerate(words) for b in words[i + 1:] if one_edit(a, b)}
    assert all(words[a][:k] == words[b][:k] and words[a][:k + 1] != words[b][:k + 1] or k == len(words[a]) for a, b, k in zip(x, y, shared))


# -- 13 ----------------------------------------------------------------------------------

def brute_negatives(rows, anchor):
    kept = sorted({(i, label, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v, label in rows
                   if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, label, v in kept:
        if not anchor(i):
            continue
        scored = sorted({(-dot(v, w), j) for j, other, w in kept if other == label and j != i})[:5]
        others = sorted({(-dot(v, w), j) for j, other, w in kept if other != label and j != i})
        for s, j in scored:
            hits = [(k, -x) for x, k in others if 50 * -s <= 100 * -x <= 95 * -s][:3]
            out |= {(i, j, rank + 1, k, -s, x) for rank, (k, x) in enumerate(hits)}
    return sorted(out)


@pytest.mark.parametrize("anchors, block, window", [(4096, 1024, 64), (7, 16, 4)])
def test_hard_negatives_equal_brute_force(spark, anchors, block, window, monkeypatch):
    for name, value in (("ANCHORS", anchors), ("BLOCK", block), ("WINDOW", window)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(4)
    center = rng.normal(size=(4, 6))
    rows = [(i, (center[i % 4] + rng.normal(size=6) * 0.5).tolist(), int(i % 4 if i % 5 else (i + 1) % 4)) for i in range(260)]
    same = rows[20][1]
    rows += [(300 + i, same, 0) for i in range(40)] + [(400 + i, same, 1) for i in range(10)]      # copies under two labels
    rows += [rows[20], rows[20], (20, rows[21][1], 0), (25, [0.0] * 6, 1), (500, [0.0] * 6, 2), (505, [], 1)]  # repeats, an id twice, zero and empty vectors
    rows += [(600, None, 1), (605, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (610, [float("nan")] * 6, 1), (615, [float("inf")] * 6, 2), (620, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(700, [1.0, 2.0], 3), (705, [1e4, 2e4, 0.0, 0.0, 0.0, 0.0], 3), (710, [9e3, 2e4, 1.0, 0.0, 0.0, 0.0], 2)]  # shorter and large vectors
    frame = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, key int, score string").repartition(5)
    mined, filtering = N.hard_negatives(frame, F.col("vec_id") % 5 == 0)
    got = sorted(map(tuple, mined.collect()))
    assert got == brute_negatives(rows, lambda i: i % 5 == 0) and len(got) > 100
    told = filtering.collect()
    assert all(0 < r.scored <= r.windows for r in told if r.windows)
    assert sum(r.scored for r in told) < sum(r.windows for r in told)  # bounds do skip windows


def test_no_anchors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    assert N.hard_negatives(frame, F.col("vec_id") % 5 == 0)[0].count() == 0
    assert N.hard_negatives(frame.where("false"), F.col("vec_id") % 5 == 0)[0].count() == 0
    assert N.hard_negatives(frame, F.lit(True))[0].count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(200, 5))).astype(np.int64)
    refs = rng.normal(size=(4, 5))
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    norm, angle = N.angles(x, refs)
    order = np.lexsort((angle[:, 0],))
    x, norm, angle = x[order], norm[order], angle[order]
    block = N.Block({"rows": 200, "label": 1, "v": x.tobytes(), "ids": np.arange(200).tobytes(), "n_ids": np.ones(200, np.int64).tobytes(),
                     "norm": norm.tobytes(), "angle": angle.astype(np.float32).tobytes()}, 4)
    low, high = block.bounds(norm, angle)
    for w, (a, b) in enumerate(zip(block.at, block.end)):
        s = N.products(x, x[a:b])
        assert (s.min(1) >= low[:, w]).all() and (s.max(1) <= high[:, w]).all()
    big = np.array([[1 << 30, 3], [5, 1 << 28]])
    assert N.products(big, big).tolist() == [[(1 << 60) + 9, (5 << 30) + (3 << 28)], [(5 << 30) + (3 << 28), (1 << 56) + 25]]
