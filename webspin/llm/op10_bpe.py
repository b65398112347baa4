"""BPE encoding and decoding with a public word-level vocabulary.

Encoding. A text is normalised and split into words as the vocabulary's file
says (NFC, white space, lower case; contractions, letter runs, single numbers,
runs of other characters). A word is a string over the byte alphabet with an
end sign. One Aho-Corasick pass finds every token at every place of the word.
From the left, the encoder takes the longest token that is compatible with the
token before it, and steps back when a place has none left. Two tokens are
compatible if merging their joint string by rank gives just these two; the
answers form the pair table, which fills as pairs are met. A prefix of a word
has one compatible sequence, so a place that failed once is never tried
again: the work is linear in the word, and the result is exactly that of
merging by rank.

Decoding looks the tokens up in one byte string with an offset table and joins
them as the tokenizer does.

Defined cases: null texts are empty; empty texts have no tokens; the
vocabulary's special strings inside a text become their ids; rows that repeat
an id get a result each. Very long words only grow the arrays of their text.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspin.llm import common as C

#: Words whose ids a Python worker keeps.
MEMO = 250_000
END = "\ue000"  # the end sign inside this module; no byte of the alphabet maps to it
SPACES = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")

#: str.split() takes these for white space, the vocabulary's rule doesn't.
NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1
    letters stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    def __init__(self, spec: dict):
        import ahocorasick

        suffix = spec["model"]["end_of_word_suffix"]
        inner = lambda s: s[:-len(suffix)] + END if s.endswith(suffix) else s
        vocab = spec["model"]["vocab"]
        self.ids = {inner(s): i for s, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        # merges: the joint token of two tokens, and the two parts of a token; a later merge has a larger id
        self.joint, self.parts = {}, {}
        for a, b in spec["model"]["merges"]:
            x, y = vocab[a], vocab[b]
            z = vocab[a + b]
            self.joint[x << 16 | y] = z
            self.parts[z] = (x, y)
        self.finder = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.finder.add_word(s, (len(s), i))
        self.finder.make_automaton()
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        # decoding: one byte string, and where each token begins; a blank leads each token
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        blob = [(" " + names.get(i, "")).encode() for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in blob])]).astype(np.int64)

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at the left (0) or right (1) edge of a token
        while its symbols merge, last one first."""
        out = self.edges[side].get(token)
        if out is None:
            out, t = [token], token
            while t in self.parts:
                t = self.parts[t][side]
                out.append(t)
            self.edges[side][token] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Do the symbols of a and b, side by side, merge to just a and b? Only
        if no two tokens that meet at the border merge before one of them
        merges away from it. Ids are times: merges happen in their order."""
        known = self.pairs.get(a << 16 | b)
        if known is not None:
            return known
        xs, ys = self.edge(a, 1), self.edge(b, 0)
        i, j, known = len(xs) - 1, len(ys) - 1, None
        while known is None:
            x_ends = xs[i - 1] if i else 1 << 30
            y_ends = ys[j - 1] if j else 1 << 30
            z = self.joint.get(xs[i] << 16 | ys[j])
            if z is not None and z < x_ends and z <= y_ends:  # of equal merges the left one comes first
                known = False
            elif not i and not j:
                known = True
            elif x_ends <= y_ends:
                i -= 1
            else:
                j -= 1
        if len(self.pairs) >= 1_000_000:
            self.pairs.clear()
        self.pairs[a << 16 | b] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        letters = self.letters
        s = "".join([letters[b] for b in word.encode()]) + END
        n = len(s)
        # the longest matches from the left, as far as each is compatible with the one before
        out: list[int] = []
        ends: list[int] = []
        p = 0
        for end, (length, token) in self.finder.iter_long(s):
            if end + 1 - length != p or (out and not self.compatible(out[-1], token)):
                break
            out.append(token)
            p = end + 1
            ends.append(p)
        if p == n:
            return out
        # step back: shorter matches, never again at a place that failed
        ids, dead = self.ids, set()
        end = min(n, p + self.longest)
        while p < n:
            while end > p:
                token = ids.get(s[p:end])
                if token is not None and end not in dead and (not out or self.compatible(out[-1], token)):
                    break
                end -= 1
            if end > p:
                out.append(token)
                ends.append(end)
                p, end = end, min(n, end + self.longest)
            else:
                dead.add(p)
                out.pop()
                end = ends.pop() - 1
                p = ends[-1] if ends else 0
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or self.cut.search(text) is None:
            return self._encode_plain(text)
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += [self._encode_plain(text[at:m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join(parts + [self._encode_plain(text[at:])])

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter alone: no final sigma
        text = text.lower()
        if NOT_SPACE.search(text):
            return b"".join([self._chunk(w) for w in WORDS.findall(text)])
        # no word crosses white space, so that whole chunks can be remembered
        known = self.memo.get
        return b"".join([known(c) or self._chunk(c) for c in text.split()])

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk without white space, remembered if short."""
        ids = self.memo.get(chunk)
        if ids is None:
            words = WORDS.findall(chunk)
            if len(words) == 1 and words[0] == chunk:
                ids = np.array(self.encode_word(chunk), "<u4").tobytes()
            else:
                ids = b"".join([self._chunk(w) for w in words])
            if len(chunk) < 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, joined by blanks."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        length = self.offsets[ids.astype(np.int64) + 1] - start
        total = np.cumsum(length)
        take = np.arange(total[-1]) + np.repeat(start - (total - length), length)
        return self.blob[take][1:].tobytes()


_CODECS: dict[int, Codec] = {}


def _codec(spec: str) -> Codec:
    key = hash(spec)
    if key not in _CODECS:
        _CODECS[key] = Codec(json.loads(spec))
    return _CODECS[key]


def _run(spec):
    schema = pa.schema([("__id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        codec = _codec(spec.value)
        for rows, data, off in C.text_pieces(batches, "__text"):
            ids, decoded = [], []
            raw = data.tobytes()
            for i in range(rows.num_rows):
                x = codec.encode(raw[off[i]:off[i + 1]].decode("utf-8", "replace"))
                ids.append(x)
                decoded.append(codec.decode(np.frombuffer(x, "<u4")).decode())
            yield pa.RecordBatch.from_arrays([rows.column("__id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=schema)
    return run


def vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary file's text (a fixed file of under 2 MB) as a broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ids (little-endian unsigned 32-bit
    integers) and decoded (the text that the ids decode to)."""
    spec = vocabulary(docs.sparkSession, path)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return base.mapInArrow(_run(spec), "__id long, ids binary, decoded string").withColumnRenamed("__id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of the rows of encode_decode."""
    return encoded.select(id_col, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
