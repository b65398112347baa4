"""Removal of byte strings that repeat anywhere in a corpus (suffix method).

A byte goes when it lies in a string of ``window`` bytes that also starts
somewhere else. Sorting every suffix of 100 TB is out of reach, so the sort
runs over *sampled* suffixes that lose no match: in each run of
``window - core + 1`` starts, the suffix whose first ``core`` bytes hash
lowest is taken, a choice that depends on the bytes alone. Two equal windows
therefore contain the same sampled suffix at the same place.

1. Each text yields its sampled suffixes: leading bytes, a hash of the first
   ``core`` bytes, and a hash of all bytes that any window through it can
   reach (its reach).
2. Sampled splitters range-partition them by leading tokens; each bucket sorts
   locally (key by key: leading bytes, core, reach) and compares neighbours,
   with the edge rows of the adjacent buckets at its borders. The order ends
   with the place in the corpus, so a hot string is split over buckets.
   A core that stands alone ends here. Equal reaches settle all their windows.
3. Only suffixes with a repeated core and a reach of their own, the ends of
   repeated passages, fetch their bytes; per core, their windows are sorted
   and compared. Cores with more members than fit one task compare their
   windows by a distributed count instead, with the same result.

Defined cases: null text is empty; texts shorter than ``window`` keep all
bytes; a repeated row is a copy, so its bytes all repeat; rows with equal ids
and different texts are separate documents; a null id is an id like any other;
columns other than the id and the text pass through and may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

#: Members of one core that a task compares at once (700 bytes each).
MEMBERS = 20_000

SUFFIX = "lead long, core long, reach long, __id long, __th long, pos int, la int, ra int"
SPAN = "__id long, __th long, start int, stop int"


def _sliding(values: np.ndarray, w: int, best) -> np.ndarray:
    """best over values[i:i+w] for every i (two accumulations in blocks)."""
    n = len(values)
    fill = values[-1:]
    pad = np.concatenate([values, np.repeat(fill, (-n) % w)]).reshape(-1, w)
    ahead = best.accumulate(pad, axis=1).ravel()
    back = best.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return best(back[:m], ahead[w - 1:w - 1 + m])


def sampled_suffixes(data: np.ndarray, off: np.ndarray, window: int, core: int):
    """(starts, prefix hash, core hashes) of the sampled suffixes of the rows."""
    n, w = len(data), window - core + 1
    prefix = C.prefix_hash(data)
    if n < window:
        return np.zeros(0, np.int64), prefix, np.zeros(0, np.uint64)
    at = np.arange(n - core + 1)
    h = C.span_hash(prefix, at, at + core) | np.uint64(1)
    order = C.mix(h) | np.uint64(1)
    low = _sliding(order, w, np.minimum)  # of the window that starts at i
    ok = np.zeros(len(low) + 1, np.int32)
    lens = np.diff(off)
    long = lens >= window
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, (off[:-1] + lens - window + 1)[long], -1)
    low[np.cumsum(ok[:-1]) == 0] = 0
    pad = np.zeros(w - 1, np.uint64)
    top = _sliding(np.concatenate([pad, low, pad]), w, np.maximum)
    starts = np.flatnonzero(top == order)
    return starts, prefix, h[starts]


def _parts(data: np.ndarray, off: np.ndarray, window: int, step: int = 1 << 20):
    """(from, to, begin of the slice, slice, offsets): a very long text in
    slices that overlap by two windows on both sides, else all at once."""
    if len(off) > 2 or len(data) <= 4 * step:
        yield 0, len(data), 0, data, off
        return
    for at in range(0, len(data), step):
        a, b = max(0, at - 2 * window), min(len(data), at + step + 2 * window)
        yield at, min(len(data), at + step), a, data[a:b], np.array([0, b - a])


def _suffix_rows(window: int, core: int):
    schema = pa.schema([("lead", pa.int64()), ("core", pa.int64()), ("reach", pa.int64()), ("__id", pa.int64()),
                        ("__th", pa.int64()), ("pos", pa.int32()), ("la", pa.int32()), ("ra", pa.int32())])

    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__text"):
            for lo, hi, shift, part, bounds in _parts(data, off, window):
                at, prefix, h = sampled_suffixes(part, bounds, window, core)
                mine = (at + shift >= lo) & (at + shift < hi)
                at, h = at[mine], h[mine]
                if not len(at):
                    continue
                row = np.searchsorted(off, at + shift, "right") - 1
                la = np.minimum(at + shift - off[row], window - core)
                ra = np.minimum(off[row + 1] - at - shift, window)
                reach = C.span_hash(prefix, at - la, at + ra)
                reach = C.mix(reach + la.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + ra.astype(np.uint64))
                lead = np.zeros(len(at), np.uint64)
                for k in range(8):
                    lead = (lead << np.uint64(8)) | part[at + k]
                lead ^= np.uint64(1 << 63)  # byte order as the order of signed longs
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(lead)), pa.array(C.signed(h)), pa.array(C.signed(reach)), rows.column("__id").take(take),
                     rows.column("__th").take(take), pa.array((at + shift - off[row]).astype(np.int32)), pa.array(la.astype(np.int32)),
                     pa.array(ra.astype(np.int32))], schema=schema)
    return run


ORDER = ["lead", "core", "reach", "__id", "__th", "pos"]


def _bucket_of(splitters: list[tuple]):
    """Adds the range bucket of each row: the number of splitters below it."""
    leads = np.array([s[0] for s in splitters], np.int64)

    def run(batches):
        for b in batches:
            lead = b.column("lead").to_numpy()
            lo, hi = np.searchsorted(leads, lead, "left"), np.searchsorted(leads, lead, "right")
            bucket = lo.astype(np.int32)
            tied = np.flatnonzero(hi > lo)  # equal leading bytes: the later keys decide
            if len(tied):
                keys = list(zip(*[b.column(c).take(pa.array(tied)).to_pylist() for c in ORDER]))
                for i, key in zip(tied, keys):
                    key = tuple(-(1 << 63) if v is None else v for v in key)
                    k = int(lo[i])
                    while k < hi[i] and splitters[k] <= key:
                        k += 1
                    bucket[i] = k
            yield b.append_column("bucket", pa.array(bucket))
    return run


def _compare_sorted(edges: dict):
    """Flags per suffix: 1 its reach repeats, 2 only its core repeats, 3 the
    first of its reach in a core with other reaches. edges: per bucket, the
    (core, reach) of the row before it and of the row after it."""
    schema = pa.schema([("__id", pa.int64()), ("__th", pa.int64()), ("pos", pa.int32()), ("la", pa.int32()),
                        ("ra", pa.int32()), ("core", pa.int64()), ("flag", pa.int32())])

    def flush(rows: pa.Table, before, after):
        core, reach = (np.asarray(rows.column(c)) for c in ("core", "reach"))
        n = len(core)
        c = np.empty(n + 2, np.int64)
        r = np.empty(n + 2, np.int64)
        c[1:-1], r[1:-1] = core, reach
        have = np.ones(n + 1, bool)  # a row stands on both sides of the gap
        c[0], r[0] = before or (0, 0)
        c[-1], r[-1] = after or (0, 0)
        have[0], have[-1] = before is not None, after is not None
        same_core = have & (c[1:] == c[:-1])
        same = same_core & (r[1:] == r[:-1])
        full = same[:-1] | same[1:]
        # runs of one reach: the first row stands for the run if its core goes on beyond the run
        lead_row = np.concatenate([[True], ~same[1:-1]])
        run = np.cumsum(lead_row) - 1
        starts = np.flatnonzero(lead_row)
        ends = np.concatenate([starts[1:], [n]])
        more = (same_core[:-1] & ~same[:-1])[starts] | (same_core[1:] & ~same[1:])[ends - 1] | same[0] * (starts == 0) | same[-1] * (ends == n)
        flag = np.where(full, np.where(lead_row & more[run], 3, 1), np.where(same_core[:-1] | same_core[1:], 2, 0)).astype(np.int32)
        keep = np.flatnonzero(flag)
        take = pa.array(keep)
        return pa.RecordBatch.from_arrays([rows.column(f.name).take(take).combine_chunks().cast(f.type) if f.name != "flag" else pa.array(flag[keep]) for f in schema], schema=schema)

    def run(batches):
        # one row is held back, so that each row sees the one after it
        held, before, bucket = None, None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            while len(t):
                k = np.asarray(t.column("bucket"))
                if bucket is not None and k[0] != bucket:
                    yield flush(held, before, edges.get(bucket, (None, None))[1])
                    held, bucket = None, None
                if bucket is None:
                    bucket = int(k[0])
                    before = edges.get(bucket, (None, None))[0]
                m = int(np.searchsorted(k, bucket, "right"))
                part, t = t.slice(0, m), t.slice(m)
                rows = part if held is None else pa.concat_tables([held, part])
                if len(rows) > 1:
                    last = rows.slice(len(rows) - 1)
                    yield flush(rows.slice(0, len(rows) - 1), before, (last.column("core")[0].as_py(), last.column("reach")[0].as_py()))
                    prev = rows.slice(len(rows) - 2, 1)
                    before = (prev.column("core")[0].as_py(), prev.column("reach")[0].as_py())
                    held = last
                else:
                    held = rows
        if held is not None:
            yield flush(held, before, edges.get(bucket, (None, None))[1])
    return run


def _fetch(window: int):
    """The bytes that the windows through each asked-for suffix can reach."""
    schema = pa.schema([("core", pa.int64()), ("bytes", pa.binary()), ("la", pa.int32()), ("own", pa.bool_()),
                        ("__id", pa.int64()), ("__th", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__text", 4 << 20):
            out = {f.name: [] for f in schema}
            raw = data.tobytes()
            for i, asked in enumerate(rows.column("asked").to_pylist()):
                did, th = rows.column("__id")[i].as_py(), rows.column("__th")[i].as_py()
                for a in asked:
                    p = int(off[i]) + a["pos"]
                    out["core"].append(a["core"])
                    out["bytes"].append(raw[p - a["la"]:p + a["ra"]])
                    out["la"].append(a["la"])
                    out["own"].append(a["flag"] == 2)
                    out["__id"].append(did)
                    out["__th"].append(th)
                    out["pos"].append(a["pos"])
                    if len(out["core"]) >= 8192:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out = {f.name: [] for f in schema}
            if out["core"]:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
    return run


def _window_keys(rows, window: int, core: int):
    """(hash of each window through each suffix, which of them exist): one row
    per suffix, one column per distance from the window's start to the suffix.
    The hash takes in the distance and the core."""
    data, off = C.string_view(rows.column("bytes"))
    la = rows.column("la").to_numpy().astype(np.int64)
    prefix = C.prefix_hash(data)
    far = np.arange(window - core + 1)
    start = (off[:-1] + la)[:, None] - far[None, :]
    real = (far[None, :] <= la[:, None]) & (start + window <= off[1:, None])
    at = np.where(real, start, 0)
    end = np.where(real, start + window, 0)
    key = C.span_hash(prefix, at, end)
    key = C.mix(key + far.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + rows.column("core").to_numpy().view(np.uint64)[:, None])
    return key, real


def _span_batch(rows, first, last, hit, window: int):
    schema = pa.schema([("__id", pa.int64()), ("__th", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    keep = np.flatnonzero(hit & np.asarray(rows.column("own")))
    take, pos = pa.array(keep), rows.column("pos").to_numpy()[keep]
    return pa.RecordBatch.from_arrays([rows.column("__id").take(take), rows.column("__th").take(take),
                                       pa.array((pos - last[keep]).astype(np.int32)), pa.array((pos - first[keep] + window).astype(np.int32))], schema=schema)


def _compare_windows(window: int, core: int):
    """Rows sorted by core: the windows of whole cores are sorted and compared
    with their neighbours in that order."""

    def flush(rows):
        rows = rows.combine_chunks().to_batches()[0]
        key, real = _window_keys(rows, window, core)
        flat = np.flatnonzero(real.ravel())
        vals = key.ravel()[flat]
        order = np.argsort(vals)
        vals = vals[order]
        same = vals[1:] == vals[:-1]
        rep = np.zeros(len(vals), bool)
        rep[1:] |= same
        rep[:-1] |= same
        again = np.zeros(real.size, bool)
        again[flat[order]] = rep
        again = again.reshape(real.shape)
        hit = again.any(axis=1)
        first = again.argmax(axis=1)
        last = again.shape[1] - 1 - again[:, ::-1].argmax(axis=1)
        return _span_batch(rows, first, last, hit, window)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) > 3000:
                c = held.column("core").to_numpy()
                cut = 3000
                while cut < len(c) and c[cut] == c[cut - 1]:
                    cut += 1
                if cut == len(c):  # the last core may go on in the next batch
                    cut = int(np.searchsorted(c != c[-1], False)) if c[0] != c[-1] else 0
                if not cut:
                    break
                yield flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield flush(held)
    return run


def _explode_windows(window: int, core: int):
    """One row per window, for cores too large for one task."""
    schema = pa.schema([("core", pa.int64()), ("far", pa.int32()), ("key", pa.int64()), ("own", pa.bool_()),
                        ("__id", pa.int64()), ("__th", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = b.slice(at, 1000)
                key, real = _window_keys(rows, window, core)
                i, far = np.nonzero(real)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([rows.column("core").take(take), pa.array(far.astype(np.int32)), pa.array(C.signed(key[i, far])),
                                                  *[rows.column(c).take(take) for c in ("own", "__id", "__th", "pos")]], schema=schema)
    return run


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([s[0], s[1]])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, window: int = 400, core: int = 128) -> DataFrame:
    """(__id, __th, start, stop) byte spans that cover exactly the bytes of
    repeated windows; spans may overlap. __th is xxhash64 of the text."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__text"))
    suffixes = C.write_read(base.mapInArrow(_suffix_rows(window, core), SUFFIX), "suffixes")

    # sampled splitters: about 20 sampled rows for each bucket
    total = suffixes.count()
    share = min(1.0, 20.0 * n / max(1, total))
    sample = sorted(tuple(-(1 << 63) if v is None else v for v in r) for r in suffixes.select(*ORDER).sample(fraction=share, seed=7).collect())
    splitters = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    placed = suffixes.mapInArrow(_bucket_of(splitters), SUFFIX + ", bucket int")
    # the rows at the borders: two for each bucket
    key = F.struct(*[F.coalesce(F.col(c), F.lit(-(1 << 63))).alias(c) for c in ORDER])
    border = {r["bucket"]: (r["lo"], r["hi"]) for r in placed.groupBy("bucket").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
    edges, ids = {}, sorted(border)
    for i, b in enumerate(ids):
        prev = border[ids[i - 1]][1] if i else None
        after = border[ids[i + 1]][0] if i + 1 < len(ids) else None
        edges[b] = (prev and (prev["core"], prev["reach"]), after and (after["core"], after["reach"]))
    flagged = (placed.repartitionById(n, "bucket").sortWithinPartitions("bucket", *ORDER)
               .mapInArrow(_compare_sorted(edges), "__id long, __th long, pos int, la int, ra int, core long, flag int"))
    flagged = C.write_read(flagged, "flagged")

    settled = flagged.where("flag in (1, 3)").select("__id", "__th", (F.col("pos") - F.col("la")).alias("start"), (F.col("pos") + F.col("ra")).alias("stop"))
    asked = (flagged.where("flag in (2, 3)").groupBy("__id", "__th")
             .agg(F.collect_list(F.struct("pos", "la", "ra", "core", "flag")).alias("asked")))
    # rows that repeat an id and a text were settled above; fetched twice, they only stand for others
    reach = (base.alias("t").join(asked.alias("a"), F.col("t.__id").eqNullSafe(F.col("a.__id")) & (F.col("t.__th") == F.col("a.__th")))
             .select("t.__id", "t.__th", "t.__text", "a.asked")
             .mapInArrow(_fetch(window), "core long, bytes binary, la int, own boolean, __id long, __th long, pos int"))
    sizes = flagged.where("flag in (2, 3)").groupBy("core").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.where(F.col("members") > MEMBERS).select("core")
    reach = C.write_read(reach, "reach")
    few = reach.join(large, "core", "left_anti").repartition(n, "core").sortWithinPartitions("core").mapInArrow(_compare_windows(window, core), SPAN)
    many = reach.join(large, "core", "left_semi").select(*reach.columns).mapInArrow(
        _explode_windows(window, core), "core long, far int, key long, own boolean, __id long, __th long, pos int")
    twice = many.groupBy("core", "far", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    many = (many.where("own").join(twice, ["core", "far", "key"], "left_semi").groupBy("__id", "__th", "pos")
            .agg(F.min("far").alias("first"), F.max("far").alias("last"))
            .select("__id", "__th", (F.col("pos") - F.col("last")).alias("start"), (F.col("pos") - F.col("first") + window).alias("stop")))
    return settled.unionByName(few).unionByName(many)


def _apply(keep_columns: list[str], schema: pa.Schema, with_text: bool):
    def run(batches):
        for b in batches:
            data, off = C.string_view(b.column("__text"))
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "__kept": []}
            spans = b.column("__spans").to_pylist()
            for i in range(b.num_rows):
                raw = data[off[i]:off[i + 1]].tobytes()
                cuts = _merge(spans[i])
                kept, at = [], 0
                for s, e in cuts:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                rest = b"".join(kept)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(rest))
                out["n_spans"].append(len(cuts))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    out["__kept"].append(rest.decode("utf-8", "ignore"))
            cols = [b.column(f.name) if f.name in keep_columns else pa.array(out[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema)], schema=schema)
    return run


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, core: int = 128,
                   with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, with ``with_text``, ``kept_text``: the
    remaining bytes as text (a character that a cut splits is left out)."""
    spans = repeated_spans(docs, id_col, text_col, window, core)
    spans = spans.groupBy("__id", "__th").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__text"))
    joined = base.alias("t").join(spans.alias("s"), F.col("t.__id").eqNullSafe(F.col("s.__id")) & (F.col("t.__th") == F.col("s.__th")), "left")
    joined = joined.select("t.__id", "t.__text", "s.__spans")
    fields = [("__id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        fields.append(("__kept", pa.string()))
        ddl += ", __kept string"
    out = joined.mapInArrow(_apply(["__id"], pa.schema(fields), with_text), ddl).withColumnRenamed("__id", id_col)
    return out.withColumnRenamed("__kept", "kept_text") if with_text else out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", window: int = 400, core: int = 128,
                   words: int = 0) -> DataFrame:
    """``docs`` with the repeated bytes taken out of its texts: same rows, same
    columns; ``length_col`` becomes the new number of code points. With ``words``,
    only maximal runs of repeated bytes that hold so many words (between white
    space, cut ones included) go. All copies of a passage go. Bytes of a
    character that a cut splits go too. Texts without repeats, null ones
    included, stay as they are."""
    spans = repeated_spans(docs, id_col, text_col, window, core)
    spans = spans.groupBy("__id", "__th").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    rest = [c for c in docs.columns if c != text_col]
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__text"), F.struct(*rest).alias("__rest"))
    joined = base.alias("t").join(spans.alias("s"), F.col("t.__id").eqNullSafe(F.col("s.__id")) & (F.col("t.__th") == F.col("s.__th")), "left")

    def run(batches):
        for b in batches:
            texts = []
            for text, cuts in zip(b.column("__text"), b.column("__spans").to_pylist()):
                if not cuts:
                    texts.append(text.as_py())
                    continue
                raw, kept, at = text.as_py().encode(), [], 0
                for s, e in _merge(cuts):
                    if words and len(raw[s:e].split()) < words:
                        continue
                    kept.append(raw[at:s])
                    at = e
                texts.append(b"".join(kept + [raw[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column("__rest")], names=["__text", "__rest"])

    done = joined.select("t.__text", "s.__spans", "t.__rest")
    done = done.mapInArrow(run, done.select("__text", "__rest").schema)
    size = F.coalesce(F.length("__text"), F.col(f"__rest.`{length_col}`")).cast(docs.schema[length_col].dataType) if length_col in docs.columns else None
    return done.select(*[F.col("__text").alias(c) if c == text_col else size.alias(c) if c == length_col else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])
