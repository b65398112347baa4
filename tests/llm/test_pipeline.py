"""Each stage of the pipeline, and run(), against brute force on a small corpus
with nulls, copies, repeated passages and planted benchmark passages."""

import collections
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import WORD, brute_components, low, words
from webspin.llm import op3_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("The " + words(rng, 9) + " and the " + words(rng, 3) + "." for _ in range(n))


def corpus():
    rng = random.Random(17)
    texts = {i: prose(rng, 10) for i in range(60)}
    texts[60] = texts[61] = texts[0]
    for i, edits in ((62, 2), (63, 4)):  # likeness in between 0.80 and 0.85 for the second
        ws = texts[i - 60].split()
        texts[i] = " ".join(ws[:-edits * 3] + words(rng, edits * 3).split())
    passage, asked = prose(rng, 8), prose(rng, 2)
    for i in (70, 71):
        texts[i] = prose(rng, 9) + " " + passage + " " + prose(rng, 9)
    short, brief = words(rng, 52), words(rng, 46)  # under 400 bytes; one of them under 50 words
    for i in (73, 74):
        texts[i] = prose(rng, 9) + "\n" + short + "\n" + prose(rng, 9)
    for i in (75, 76):
        texts[i] = prose(rng, 9) + "\n" + brief + "\n" + prose(rng, 9)
    texts[72] = prose(rng, 4) + " " + asked + " " + prose(rng, 4)
    texts |= {80 + i: (words(rng, 60).upper().replace(" ", "!! ") if i % 2 else words(rng, 60).replace(" ", "%%% ")) for i in range(12)}
    rows = [*texts.items(), (95, None), (96, ""), (None, prose(rng, 10))]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], [(1, asked), (2, None), (3, texts[5].upper()), (None, "not in there at all")]


def without_repeats(texts, window=200, words=50):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if count[b[i:i + window]] > 1:
                gone[i + 1:i + window + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        kept, at = b"", 0
        for s, e in zip(edges[::2], edges[1::2]):
            if len(b[s:e].split()) >= words:
                kept += b[at:s]
                at = e
        out.append((kept + b[at:]).decode("utf-8", "ignore"))
    return out


def contaminated(text, items):
    patterns = [WORD.findall(low(t)) for t in items]
    windows = {tuple(w[k:k + 10]) for w in patterns if w for k in range(max(1, len(w) - 9))}
    w = WORD.findall(low(text))
    return any(tuple(w[k:k + n]) in windows for n in {len(p) for p in windows} for k in range(len(w) - n + 1))


def encoded(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def docs_text(docs, i):
    return next(r[1] for r in docs if r[0] == i)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (docs, items) = str(tmp_path_factory.mktemp("corpus")), corpus()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_run_equal_brute_force(spark, folder):
    docs, items = corpus()
    table = spark.read.parquet(f"{folder}/documents.parquet")
    good = {(r.doc_id) for r in op3_quality.score_quality(table, op3_quality.train(table)).collect() if r.predicted}
    want = [r for r in docs if r[0] in good]
    steps = [want]
    comps = brute_components([r[:3] for r in want], 80)
    steps.append([r for r, (i, _, c) in zip(want, comps) if i is None or i == c])
    steps.append([(r[0], None if r[1] is None else t, r[2], r[3], None if r[1] is None else len(t)) for r, t in zip(steps[1], without_repeats([r[1] for r in steps[1]]))])
    steps.append([r for r in steps[2] if not contaminated(r[1], [t for _, t in items])])
    steps.append(list(encoded(steps[3])))
    after = {r[0]: r[1] for r in steps[2]}
    assert all(len(t) < len(docs_text(docs, i)) for i in (70, 71, 73, 74) for t in [after[i]]) and all(after[i] == docs_text(docs, i) for i in (75, 76))
    # every stage has something to take away, and the links at 80 percent are more than those at 85
    assert len(docs) > len(steps[0]) > len(steps[1]) > len(steps[3]) > 40 and steps[1] != steps[2]
    assert brute_components([r[:3] for r in want], 85) != comps
    given = docs
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        got = stage(spark, spark.createDataFrame(given, DOCS).repartition(3), folder).collect()
        assert ordered(got) == ordered(step), name
        given = step
    assert ordered(corpus_pipeline.run(spark, folder).collect()) == ordered(steps[-1])
