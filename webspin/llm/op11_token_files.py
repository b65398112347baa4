"""Token ids in compressed binary files with access to single documents.

Format. A folder holds shards, one dictionary and one manifest. A shard is

    ZTOKENS1 | sha256 of the dictionary | frames | index | n, place of the index | ZTOKENS1

Every document is a zstandard frame of its own (its ids as little-endian
unsigned 32-bit integers), compressed with the one dictionary that all shards
share. The index lists, in ascending id order, the documents' ids, whether the
id is null, the frames' offsets and the documents' token counts. The manifest
names the committed shards in order, with their rows, tokens, first and last id.

Spark reads and writes the format as the data source ``ztokens``. Each write
task streams one range of ids into a shard of a new name; the driver's commit
writes the manifest, so shards of failed or repeated attempts are never read.
A read is split by ranges of documents; with the option ``ids`` it opens only the
shards, and reads only the frames, of these documents.

The dictionary is trained on serialized ids: ``PIECES`` pieces of ``PIECE`` ids, those of
least hash among the ``SAMPLE`` distinct texts of least hash. All else covers all rows.

Encoding takes the ids of the tokenizers library. A worker keeps the ids of words
and asks the library for new words only.

The dictionary is trained on serialized ids: ``PIECES`` pieces of ``PIECE`` ids, those of
least hash among the ``SAMPLE`` distinct texts of least hash. All else covers all rows.

Encoding takes the ids of the tokenizers library. A worker keeps the ids of words
and of chunks between white space and asks the library for new ones only; a
text with a character that Python and the vocabulary's rule for white space
disagree on goes to the library whole.

Defined cases: null and empty texts have just the end id; rows without an id
come first; rows that repeat an id are ordered by their texts' hash, and among
equal texts by place; an empty table gives a manifest without shards. A frame
holds one text, so very long texts only grow their own frame.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from webspin.llm import common as C

MAGIC = b"ZTOKENS1"
#: Texts and pieces that the dictionary is trained on, ids of a piece, bytes of the dictionary.
SAMPLE, PIECES, PIECE, DICTIONARY = 512, 2048, 512, 64 << 10
LEVEL = 3
#: Words whose ids a Python worker keeps, documents of a read task, letters that the library gets at once.
MEMO, READ, LONG = 500_000, 50_000, 1 << 20
#: The end id of each document.
END = 2
#: What the vocabulary's rule takes for a word, by byte of a plain text: white space, letters, digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[97:123] = LETTER
KIND[128:192] = KIND[0xC3] = LETTER
KIND[48:58] = DIGIT
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Bytes that plain texts don't have: control signs, and all letters beyond U+00FF.
ODD = np.ones(256, bool)
ODD[[9, 10, 11, 12, 13, 0xC3]] = False
ODD[32:127] = False
ODD[128:192] = False
BLANK = re.compile(" (?! )")
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def _take(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all places of the spans, one span after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


class Pool:
    """Values of many spans in one growing array."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> int:
        """Where the values begin."""
        at, self.used = self.used, self.used + len(values)
        if self.used > len(self.data):
            self.data = np.concatenate([self.data[:at], np.zeros(max(self.used, 2 * len(self.data)) - at, self.data.dtype)])
        self.data[at:self.used] = values
        return at


class Memo:
    """Words and their ids as sorted arrays of hashes with spans in pools. Of
    more than MEMO words those used last stay."""

    def __init__(self):
        self.key = np.zeros(0, np.uint64)
        self.col = {c: np.zeros(0, np.int64) for c in ("word", "letters", "ids", "tokens", "used")}
        self.bytes, self.values, self.clock = Pool(np.uint8), Pool(np.uint16), 0

    def find(self, key, data, start, size):
        """Place of each word; which of them are known (bytes compared), and
        whether another word has the hash of one."""
        at = np.searchsorted(self.key, key)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == key[known]
        met = int(known.sum())
        known[known] = self.col["letters"][at[known]] == size[known]
        hit = np.flatnonzero(known)
        if len(hit):
            same = data[_take(start[hit], size[hit])] == self.bytes.data[_take(self.col["word"][at[hit]], size[hit])]
            known[hit[np.add.reduceat(~same, np.cumsum(size[hit]) - size[hit]) > 0]] = False
        return at, known, met > int(known.sum())

    def enter(self, key, data, start, size, ids, tokens):
        if len(self.key) and len(self.key) + len(key) > MEMO:
            self._drop(min(self.clock - 1, int(np.sort(self.col["used"])[len(self.key) // 2])))
        at = np.searchsorted(self.key, key)
        new = {"word": self.bytes.add(data[_take(start, size)]) + np.cumsum(size) - size, "letters": size,
               "ids": self.values.add(ids) + np.cumsum(tokens) - tokens, "tokens": tokens, "used": np.full(len(key), self.clock)}
        self.key = np.insert(self.key, at, key)
        self.col = {c: np.insert(x, at, new[c]) for c, x in self.col.items()}

    def _drop(self, before: int):
        keep = self.col["used"] > before
        col = {c: x[keep] for c, x in self.col.items()}
        bytes_, values = self.bytes.data[_take(col["word"], col["letters"])], self.values.data[_take(col["ids"], col["tokens"])]
        self.key, self.bytes, self.values = self.key[keep], Pool(np.uint8), Pool(np.uint16)
        self.bytes.add(bytes_)
        self.values.add(values)
        col["word"], col["ids"] = np.cumsum(col["letters"]) - col["letters"], np.cumsum(col["tokens"]) - col["tokens"]
        self.col = col


def word_starts(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of lower-case plain texts by the vocabulary's rule: contractions,
    letter runs, single digits, runs of others. (start, end)"""
    n = len(low)
    kind = KIND[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.ones(n, bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begins |= edge[:-1]
    quote = np.flatnonzero((low == 39) & begins)
    row_end = offsets[np.searchsorted(offsets, quote, "right")]
    for tail in CONTRACTIONS:
        k = len(tail)
        at = quote[quote + k < row_end]
        for i, c in enumerate(tail):
            at = at[low[at + 1 + i] == c]
        begins[at + 1] = False
        inside = at + k + 1
        inside = inside[inside < row_end[np.searchsorted(quote, at)]]
        begins[inside] = True  # the rest of a letter run is a word of its own
    place = np.flatnonzero(begins)
    end = np.append(place[1:], n)
    word = kind[place] != SPACE
    return place[word], end[word]


class Encoder:
    """The library's ids of whole texts. Plain texts (ASCII and Latin letters)
    are lower-cased and cut into words here, as arrays over many texts; the
    library merges the letters of words that are not in the memo. All other
    texts go through all rules of the library."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.core = Tokenizer.from_str(spec), Tokenizer.from_str(spec)
        for t in (self.library, self.core):
            t.no_truncation()
            t.no_padding()
        self.core.normalizer = normalizers.Sequence([])
        self.core.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.core.get_vocab()
        if max(names.values()) >= 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.last = np.zeros(max(names.values()) + 1, bool)  # tokens that end a word
        self.last[[i for s, i in names.items() if s.endswith("</w>")]] = True
        self.memo = Memo()

    def whole(self, text: str) -> np.ndarray:
        """Ids by all rules of the library; a long text piece by piece, as no
        rule looks across white space."""
        out, at = [], 0
        while at < len(text):
            cut = BLANK.search(text, at + LONG)
            to = cut.start() if cut else len(text)
            out.append(np.array(self.library.encode_batch_fast([text[at:to]], add_special_tokens=False)[0].ids, np.uint16))
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint16)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words, and how many each has."""
        lines = [" ".join(words[i:i + 200]) for i in range(0, len(words), 200)]
        ids = [np.array(e.ids, np.uint16) for e in self.core.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(ids)
        tokens = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(tokens) != len(words) or tokens.sum() != len(ids):
            raise ValueError("the vocabulary does not mark the ends of words")
        return ids, tokens

    def plain(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, ids per text) of plain texts; None if two words share a hash."""
        memo = self.memo
        memo.clock += 1
        low = C.LOWER[data]
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        low[second[data[second] < 0x9F]] += 0x20
        start, end = word_starts(low, offsets)
        if not len(start):
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        size = end - start
        key, first, own = np.unique(C.span_hash(C.prefix_hash(low), start, end), return_index=True, return_inverse=True)
        twin = start[first][own]
        if (size != size[first][own]).any() or (low[_take(start, size)] != low[_take(twin, size)]).any():
            return None
        one, letters = start[first], size[first]
        at, known, clash = memo.find(key, low, one, letters)
        if clash:
            return None
        memo.col["used"][at[known]] = memo.clock
        new = np.flatnonzero(~known)
        if len(new):
            raw = low.tobytes()
            ids, tokens = self.merged([raw[x:y].decode() for x, y in zip(one[new].tolist(), (one + letters)[new].tolist())])
            memo.enter(key[new], low, one[new], letters[new], ids, tokens)
            at = np.searchsorted(memo.key, key)
        tokens, ids = memo.col["tokens"][at][own], memo.col["ids"][at][own]
        row = np.searchsorted(offsets, start, "right") - 1
        return memo.values.data[_take(ids, tokens)], np.bincount(row, tokens, len(offsets) - 1).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a piece."""
        n = len(offsets) - 1
        odd = ODD[data]
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)                              # <| may begin a special string
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))        # the two signs among the letters
        strange = np.zeros(n, bool)
        strange[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        plain = np.flatnonzero(~strange)
        out: list = [None] * n
        if len(plain):
            size = np.diff(offsets)[plain]
            found = self.plain(data[_take(offsets[plain], size)], np.concatenate([[0], np.cumsum(size)]))
            if found is not None:
                for i, x in zip(plain.tolist(), np.split(found[0], np.cumsum(found[1])[:-1])):
                    out[i] = x
        for i in range(n):
            if out[i] is None:
                out[i] = self.whole(data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary file's text (a fixed file of under 2 MB) as a broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _encode(spec, end):
    tail = np.array([end], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder = _encoder(spec.value)
        for rows, data, off in C.text_pieces(batches, "text"):
            ids = [x.astype("<u4").tobytes() + tail for x in encoder.encode(data, off)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], schema=schema)
    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, ids) in the rows' own order; ids ends with ``end``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_encode(vocabulary(docs.sparkSession, path), end), "doc_id long, ids binary")


def _pieces(batches):
    seen = set()
    for batch in batches:
        for x in batch.column("ids"):
            ids = x.as_buffer()
            out = [bytes(ids[i:i + 4 * PIECE]) for i in range(0, ids.size, 4 * PIECE)]
            out = [p for p in out if p not in seen]
            if len(seen) < 4 * PIECES:  # skips copies; the rest is done by the caller
                seen.update(out)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["piece"])


def train_dictionary(docs: DataFrame, text_col: str = "text", path: str | None = None, end: int = END, size: int = DICTIONARY) -> bytes:
    """Bytes of a dictionary for the ids of all documents (see module)."""
    import zstandard

    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    least = [r.h for r in texts.groupBy("h").agg(F.lit(1).alias("one")).orderBy("h").limit(SAMPLE).collect()]
    if not least:
        return b""
    drawn = texts.where(F.col("h") <= least[-1]).select(F.lit(0).alias("id"), "text")
    pieces = encode(drawn, "id", "text", path, end).select("ids").mapInArrow(_pieces, "piece binary")
    rows = pieces.groupBy("piece").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("piece"), "piece").limit(PIECES).collect()
    pieces = [bytes(r.piece) for r in rows]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: they serve as they are
        return b"".join(pieces)[-size:]


def _dictionary(raw: bytes):
    import zstandard

    trained = raw[:4] == b"\x37\xa4\x30\xec"  # the mark of a trained dictionary
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _store(path: str):
    """File system and path of a URI that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _get(path: str, name: str) -> bytes:
    store, base = _store(path)
    with store.open_input_stream(posixpath.join(base, name)) as f:
        return f.read()


def _put(path: str, name: str, data: bytes) -> None:
    store, base = _store(path)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(posixpath.join(base, name)) as f:
        f.write(data)


@dataclass
class Shard(WriterCommitMessage):
    """What a write task tells the commit: a line of the manifest."""

    partition: int
    name: str
    rows: int
    tokens: int
    first: int | None
    last: int | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, dictionary: str):
        self.path, self.dictionary = path, dictionary

    def write(self, batches):
        import zstandard
        from pyspark import TaskContext

        raw = _get(self.path, f"{self.dictionary}.zdict")
        if hashlib.sha256(raw).hexdigest() != self.dictionary:
            raise OSError("the dictionary's bytes don't have the hash that names it")
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw) if raw else None).compress
        partition = TaskContext.get().partitionId()
        name = f"shard-{partition:06d}-{uuid.uuid4().hex}.ztok"
        ids, sizes, tokens = [], [], []
        store, base = _store(self.path)
        file = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                file = store.open_output_stream(posixpath.join(base, name))
                file.write(MAGIC + bytes.fromhex(self.dictionary))
            data, off = C.string_view(batch.column("ids"))
            raw = memoryview(data)
            frames = [pack(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            file.write(b"".join(frames))
            ids.append(batch.column("doc_id"))
            sizes.append(np.array([len(f) for f in frames], np.int64))
            tokens.append(np.diff(off) // 4)
        if file is None:
            return Shard(partition, name, 0, 0, None, None)
        ids, sizes, tokens = pa.chunked_array(ids).combine_chunks(), np.concatenate(sizes), np.concatenate(tokens)
        begin = len(MAGIC) + 32
        offsets = begin + np.concatenate([[0], np.cumsum(sizes)])
        file.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes() + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                   + offsets.astype("<u8").tobytes() + tokens.astype("<u8").tobytes())
        file.write(np.array([len(ids), offsets[-1]], "<u8").tobytes() + MAGIC)
        file.close()
        return Shard(partition, name, len(ids), int(tokens.sum()), ids[0].as_py(), ids[-1].as_py())

    def commit(self, messages):
        shards = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        lines = [{"name": m.name, "rows": m.rows, "tokens": m.tokens, "first": m.first, "last": m.last} for m in shards]
        _put(self.path, "manifest.json", json.dumps({"dictionary": self.dictionary, "shards": lines}).encode())

    def abort(self, messages):
        store, base = _store(self.path)
        for m in messages:
            if m is not None and m.rows:
                store.delete_file(posixpath.join(base, m.name))


@dataclass
class Part(InputPartition):
    """Documents [begin, end) of a shard, or those of ``ids``; ``start`` counts the
    tokens of all shards before."""

    name: str
    start: int
    begin: int
    end: int
    ids: tuple


class Index:
    """The index at the end of a shard."""

    def __init__(self, file, dictionary: str):
        size = file.size()
        tail = file.read_at(24, size - 24)
        head = file.read_at(40, 0)
        if tail[16:] != MAGIC or head != MAGIC + bytes.fromhex(dictionary):
            raise OSError("not a token shard of this dictionary")
        n, at = (int(x) for x in np.frombuffer(tail[:16], "<u8"))
        raw = file.read_at(size - 24 - at, at)
        self.ids = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        self.tokens = np.frombuffer(raw, "<u8", n, 9 * n + 8 * (n + 1)).astype(np.int64)


class Reader(DataSourceReader):
    def __init__(self, path: str, ids: tuple | None):
        self.path, self.ids = path, ids
        self.manifest = json.loads(_get(path, "manifest.json"))

    def partitions(self):
        out, start = [], 0
        for s in self.manifest["shards"]:
            if self.ids is None:
                out += [Part(s["name"], start, i, min(s["rows"], i + READ), ()) for i in range(0, s["rows"], READ)]
            else:
                wanted = tuple(i for i in self.ids if s["last"] is not None and i <= s["last"] and (s["first"] is None or i >= s["first"]))
                if wanted:
                    out.append(Part(s["name"], start, 0, s["rows"], wanted))
            start += s["tokens"]
        return out or [Part("", 0, 0, 0, ())]

    def read(self, part):
        import zstandard

        if not part.name:
            return
        dictionary = self.manifest["dictionary"]
        raw = _get(self.path, f"{dictionary}.zdict")
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw) if raw else None).decompress
        store, base = _store(self.path)
        with store.open_input_file(posixpath.join(base, part.name)) as file:
            index = Index(file, dictionary)
            start = part.start + np.concatenate([[0], np.cumsum(index.tokens)])
            if part.ids:
                low = int(index.null.sum())
                runs = [(low + int(np.searchsorted(index.ids[low:], i, "left")), low + int(np.searchsorted(index.ids[low:], i, "right"))) for i in part.ids]
            else:
                runs = [(part.begin, part.end)]
            for begin, end in runs:
                for a, b in C.row_pieces(index.offsets[begin:end + 1], 1 << 20):
                    a, b = a + begin, b + begin
                    at = index.offsets[a:b + 1]
                    data = memoryview(file.read_at(int(at[-1] - at[0]), int(at[0])))
                    at = (at - at[0]).tolist()
                    ids = [unpack(data[x:y]) for x, y in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index.ids[a:b], pa.int64(), mask=index.null[a:b]), pa.array(start[a:b]), pa.array(index.tokens[a:b]), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """``ztokens``: options path, dictionary (write: its sha256) and ids (read:
    comma-separated ids to fetch)."""

    @classmethod
    def name(cls):
        return "ztokens"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        ids = self.options.get("ids")
        return Reader(self.options["path"], None if ids is None else tuple(sorted({int(i) for i in ids.split(",") if i.strip()})))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], self.options["dictionary"])


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end: int = END) -> str:
    """Write the ids of all whole texts in ascending id order; returns the
    dictionary's sha256."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    raw = train_dictionary(docs, text_col, vocabulary_path, end)
    name = hashlib.sha256(raw).hexdigest()
    _put(path, f"{name}.zdict", raw)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("__place")]
    dealt = base.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(C.partitions(spark), *order).sortWithinPartitions(*order)
    encode(dealt, "doc_id", "text", vocabulary_path, end).write.format("ztokens").option("dictionary", name).mode("append").save(path)
    return name


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of all documents, or of those of ``ids``."""
    spark.dataSource.register(TokenFiles)
    reader = spark.read.format("ztokens")
    if ids is not None:
        reader = reader.option("ids", ",".join(map(str, ids)))
    return reader.load(path)


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows of read_tokens."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
