import base64
import hashlib
import random
from collections import Counter

import duckdb
import pyarrow.fs

from webskein.llm import common, warc

SCHEMA = "page_id bigint, url string, html string, payload string"


def brute(rows):
    best = {}
    for k, (i, _, h, _) in enumerate(rows):
        key = (i is not None, i or 0, k)
        best[h or ""] = max(best.get(h or "", key), key)
    out = []
    for k, (i, _, h, _) in enumerate(rows):
        p, first = (h or "").encode(), best[h or ""]
        revisit = first[2] != k
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", (first[1] if first[0] else None) if revisit else None))
    return Counter(map(str, out))


def result(df):
    return Counter(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def test_odd_pages(spark):
    rows = [(1, "http://a.example.com/x", "same", "p"), (2, None, "same", "p"), (3, "http://a.example.com/x", None, "p"), (4, "", "", "p"), (None, "http://b.org", "nul\x00é\r\n\r\n", "p"), (5, "http://a.example.com/x", "same", "p"), (6, "https://u@Host.ORG:80/é /\n?q#f", "long " * 300000, "p"), (7, "x", "twice", "p"), (7, "x", "twice", "p"), (None, "y", "twice", "p")]
    assert result(warc.round_trip(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rnd = random.Random(4)
    rows = [(rnd.randrange(60), f"http://h{rnd.randrange(3)}.example.com/{rnd.randrange(9)}", rnd.choice("abc") * rnd.randrange(4), "p") for _ in range(300)]
    rows += [(500, "http://one.example.com/", "hot", "p")] * 40
    pages = spark.createDataFrame(rows, SCHEMA)
    # payload ties within a page_id may make any of its rows the response: the counts are fixed
    assert result(warc.round_trip(pages)) == brute(rows)
    folder = common.scratch(spark, "test")
    files = warc.build(pages, folder)
    reader = warc.Reader(folder, sorted((warc._key(r.url_key, r.page_id), r.name) for r in files.collect()))
    assert sum(1 for _ in reader.captures("com,example,one)/", 500)) == 40
    assert not list(reader.captures("com,example,one)/", 501)) and not list(reader.captures("zzz", 1)) and not list(reader.captures("", 1))
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    found = [r for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/warc")) for r in warc.records(fs.open_input_stream(f.path, compression=None).read())]
    assert len(found) == len(rows) and all(r["payload_bytes"] == len(r["payload"]) for r in found if r["payload"] is not None)


def test_pages_equal_sql(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    pages = spark.read.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    want = Counter(str((r[0], r[1], r[2], r[3], r[4])) for r in con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE})").fetchall())
    assert result(warc.round_trip(pages)) == want == brute([(r.page_id, r.url, r.html, "") for r in pages.collect()])


def test_url_keys(spark):
    df = spark.createDataFrame([("https://www.Example.com:8080/Path?q",), ("no host",), (None,), ("http://a.b",)], "url string")
    assert [r[0] for r in df.select(warc.url_key(df.url)).collect()] == ["com:8080,example,www)/Path?q", "no host", "", "b,a)"]
