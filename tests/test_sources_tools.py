"""Crawl dumps, names in texts and table functions against brute force."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from webspin.functions import tools
from webspin.operators import names as N
from webspin.operators import search as S
from webspin.sources import dump as D
from webspin.sources.tables import fetch_outcomes

ROWS = [("https://a.org/1", 200, "<p>ü body\r\n\r\nWARC/1.0\r\nnot a record"), ("https://a.org/2", 404, ""), ("https://b.org/\n3", 500, None), (None, None, "x" * 5000), ("https://c.org", 301, "end\n")]


def test_dump_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/dump"
    frame = spark.createDataFrame([(*r, {"k": f"v{i}"}) for i, r in enumerate(ROWS)], "url string, status_code int, content string, headers map<string,string>")
    D.write_dump(frame.withColumn("fetched", F.lit("2024-02-03 04:05:06.789").cast("timestamp")).repartition(3), path)
    got = {r.headers["k"]: r for r in D.read_dump(spark, path).collect()}
    assert len(got) == len(ROWS) and got["v0"].content == ROWS[0][2] and got["v0"].status_code == 200 and got["v2"].url == "https://b.org/ 3"
    assert got["v3"].declared_length == 5000 and got["v0"].fetched.microsecond == 789000 and all(r.read_error is None for r in got.values())
    small = {r.headers["k"]: r for r in D.read_dump(spark, path, max_bytes=100).collect()}
    assert len(small["v3"].content) == 100 and small["v3"].declared_length == 5000 and small["v4"].content == "end\n"
    out = {r.url: r for r in fetch_outcomes(D.read_dump(spark, path, max_bytes=100), max_bytes=100).collect()}
    assert out["https://a.org/2"].error == "HTTP 404" and out["https://a.org/1"].success
    open(f"{tmp_path}/dump/part-lost.warc", "wb").write(b"of an attempt that failed")
    assert D.read_dump(spark, path).count() == len(ROWS)


def test_dump_from_elsewhere(spark, tmp_path):
    def record(kind, uri, reply):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: {len(reply)}\r\n\r\n".encode() + reply + b"\r\n\r\n"
    good = record("warcinfo", "", b"software: x\r\n") + record("response", "http://q.org/", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 4\r\n\r\nbody")
    good += record("request", "http://q.org/", b"GET / HTTP/1.1\r\n\r\n") + record("response", "http://r.org/", b"HTTP/1.0 503 Busy\r\n\r\n")
    with gzip.open(tmp_path / "one.warc.gz", "wb") as f:
        f.write(good)
    (tmp_path / "two.warc").write_bytes(good[:-30])       # cut short
    (tmp_path / "three.warc").write_bytes(b"something else\n\n")
    (tmp_path / "four.warc").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"not a dump")
    rows = [(r.url, r.status_code, r.content, r.read_error is None) for r in D.read_dump(spark, f"file://{tmp_path}").collect()]
    assert sorted(r[:3] for r in rows if r[3]) == [("http://q.org/", 200, "body")] * 2 + [("http://r.org/", 503, "")]
    assert sum(not r[3] for r in rows) == 2


def test_names_in_texts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc.") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", None, "aé日b", "日"]
    names = ["".join(rng.choice("abc.") for _ in range(rng.randint(3, 5))) for _ in range(40)] + ["é日", None, "bb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])], "id int, host string").repartition(4)

    def check(names):
        table = spark.createDataFrame([(n,) for n in names], "name string")
        hit = lambda t: t is not None and any(n is not None and n in t for n in names)
        want = {i for i, t in enumerate(texts + texts[:50]) if hit(t)}
        assert {r.id for r in S.keep_preferred(df, table).collect()} == want
        assert {r.id for r in S.drop_blocked(df, table).collect()} == set(range(len(texts) + 50)) - want
        return want
    assert 20 < len(check(names)) < 400
    check(["日", "."])
    check([""])
    check([])


def test_names_plan_has_no_nested_loop(spark):
    names = spark.range(100_000).select(F.concat(F.lit("host"), F.col("id"), F.lit(".example")).alias("name"))
    df = spark.range(1000).select(F.concat(F.lit("www.host"), F.col("id") * 250, F.lit(".example.org")).alias("host"))
    kept = S.keep_preferred(df, names)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert kept.count() == 400  # host ids 0 to 99,750
    assert N.filed_names(names).count() == 100_000


def test_table_functions(spark):
    def halves(text, n):
        if n == 0:
            raise ValueError("no parts asked for")
        for i in range(n):
            yield i, text[i::n], None
    tools.register_tool(spark, "halves", halves, "i int, part string, error string")
    got = spark.sql("SELECT t.n, h.* FROM VALUES ('abcd', 2), ('x', 0) AS t(text, n), LATERAL halves(t.text, t.n) h").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(["(2, 0, 'ac', None)", "(2, 1, 'bd', None)", "(0, None, None, 'ValueError: no parts asked for')"])
    tools.register_tool(spark, "strict", halves, "i int, part string, e int")
    with pytest.raises(Exception, match="no parts asked for"):
        spark.sql("SELECT * FROM strict('x', 0)").collect()
    tools.register_page_elements(spark)
    got = spark.sql("SELECT * FROM page_elements('<ul><li>a<li><b>c</b></ul>', array('li > b', 'ul')) ORDER BY n").collect()
    assert [tuple(r) for r in got] == [("ul", 0, "ul", "ac"), ("li > b", 3, "b", "c")]
