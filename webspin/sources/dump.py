"""Crawl dumps: files of WARC response records as a Spark data source (``crawldump``).

A record is a header block (target URI, time, length) and an HTTP response:
status line, headers, body. One task reads one file as a stream, record by
record; gzip files (``.gz``) are read through. A body that is declared, or found, to be
longer than the option ``maxBytes`` is passed over without being kept: its row has
the length, and a body cut to ``maxBytes``. Rows that don't parse end their file
with a row whose ``read_error`` says where.

Writing: each task streams its rows into a file of a new name; the commit lists the
files in ``_files.json``, and only listed files are read. A folder without a list
(a dump from elsewhere) is read whole.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "url string, fetched timestamp, status_code int, headers map<string,string>, declared_length long, content string, read_error string"
ARROW = pa.schema([("url", pa.string()), ("fetched", pa.timestamp("us", "UTC")), ("status_code", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())),
                   ("declared_length", pa.int64()), ("content", pa.string()), ("read_error", pa.string())])
MAX_BYTES = 10 * 1024 * 1024
LIST = "_files.json"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _block(file) -> dict[str, str] | None:
    """Header lines up to a blank one, the first line under an empty name; None
    at the end of the file."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    out = {"": line.decode("utf-8", "replace").strip()}
    for line in iter(file.readline, b""):
        if line in (b"\r\n", b"\n"):
            return out
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    raise ValueError("a header block has no end")


class _Limited:
    """The first ``size`` bytes of a file."""

    def __init__(self, file, size: int):
        self.file, self.left = file, size

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data

    def readline(self) -> bytes:
        line = self.file.readline(self.left)
        self.left -= len(line)
        return line

    def skip(self) -> None:
        while self.left and self.read(1 << 20):
            pass


def records(file, max_bytes: int):
    """Rows of one file."""
    count = 0
    try:
        while (head := _block(file)) is not None:
            if not head[""].startswith("WARC/"):
                raise ValueError("no record begins here")
            part = _Limited(file, int(head["content-length"]))
            if head.get("warc-type") == "response":
                reply = _block(part) or {"": ""}
                status = re.match(r"HTTP/\S+ (\d+)", reply.pop(""))
                size = int(reply.get("content-length", part.left)) if reply.get("content-length", "0").isdigit() else part.left
                body = part.read(max_bytes)
                if part.left and len(body) < max_bytes:
                    raise ValueError("the file ends inside a record")
                when = head.get("warc-date")
                yield {"url": head.get("warc-target-uri"), "fetched": datetime.fromisoformat(when.replace("Z", "+00:00")).astimezone(timezone.utc) if when else None,
                       "status_code": int(status[1]) if status else 0, "headers": list(reply.items()), "declared_length": size,
                       "content": body.decode("utf-8", "replace"), "read_error": None}
            part.skip()
            if part.left:
                raise ValueError("the file ends inside a record")
            count += 1
    except (ValueError, KeyError, EOFError, OSError) as problem:
        yield {"url": None, "fetched": None, "status_code": 0, "headers": [], "declared_length": None, "content": None, "read_error": f"record {count}: {problem}"}


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes = path, max_bytes

    def partitions(self):
        from pyarrow import fs

        store, base = _store(self.path)
        if store.get_file_info(posixpath.join(base, LIST)).type == fs.FileType.File:
            with store.open_input_stream(posixpath.join(base, LIST)) as f:
                names = [posixpath.join(base, n) for n in json.loads(f.read())]
        else:
            found = store.get_file_info(fs.FileSelector(base, recursive=True))
            names = sorted(i.path for i in found if i.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path))
        return [File(n) for n in names] or [File("")]

    def read(self, part):
        if not part.path:
            return
        store, _ = _store(self.path)
        with store.open_input_stream(part.path, compression=None) as raw:
            file = gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else _Buffered(raw)
            rows, size = [], 0
            for row in records(file, self.max_bytes):
                rows.append(row)
                size += len(row["content"] or "")
                if len(rows) == 256 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class _Buffered:
    """Lines and bytes of an Arrow stream."""

    def __init__(self, raw):
        import io

        self.file = io.BufferedReader(raw, 1 << 20)

    def read(self, n: int) -> bytes:
        return self.file.read(n)

    def readline(self, n: int = -1) -> bytes:
        return self.file.readline(n)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches):
        store, base = _store(self.path)
        name, file = f"part-{uuid.uuid4().hex}.warc", None
        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    store.create_dir(base, recursive=True)
                    file = store.open_output_stream(posixpath.join(base, name))
                body = (row["content"] or "").encode()
                given = dict(row["headers"] or [])
                if row["declared_length"] is not None:
                    given["content-length"] = str(row["declared_length"])
                reply = f"HTTP/1.1 {row['status_code'] or 0}\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in given.items()) + "\r\n"
                reply = reply.encode() + body
                head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {_line(row['url'])}\r\n"
                if row["fetched"] is not None:
                    head += f"WARC-Date: {row['fetched'].astimezone(timezone.utc).isoformat()}\r\n"
                file.write(f"{head}Content-Length: {len(reply)}\r\n\r\n".encode() + reply + b"\r\n\r\n")
        if file is not None:
            file.close()
        return Written(name if file is not None else None)

    def commit(self, messages):
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(posixpath.join(base, LIST)) as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())

    def abort(self, messages):
        store, base = _store(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(posixpath.join(base, m.name))


def _line(value) -> str:
    return re.sub(r"[\r\n]+", " ", str(value if value is not None else ""))


class CrawlDump(DataSource):
    @classmethod
    def name(cls):
        return "crawldump"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("maxbytes", MAX_BYTES)))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


def read_dump(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A1: the records of a crawl dump as fetches (SCHEMA)."""
    spark.dataSource.register(CrawlDump)
    return spark.read.format("crawldump").option("maxBytes", max_bytes).load(path)


def write_dump(fetches: DataFrame, path: str) -> None:
    """Fetches (url, status_code, content; optionally fetched, headers,
    declared_length) as a crawl dump, one file per task."""
    from pyspark.sql import functions as F

    spark = fetches.sparkSession
    spark.dataSource.register(CrawlDump)
    kinds = {f.split(" ")[0]: f.split(" ")[1] for f in SCHEMA.split(", ")}
    rows = fetches.select(*[(F.col(c) if c in fetches.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    rows.write.format("crawldump").mode("append").save(path)
