import random
from datetime import datetime, timedelta
from urllib.robotparser import RobotFileParser


import pytest
from pyspark.sql import functions as F

from webskein.functions import hashing
from webskein.operators import dedup, frontier, language, politeness, robots, search
from webskein.plans import pipeline
from webskein.sources import fetching, stores
from webskein.streaming import crawl as stream

ROBOTS = "User-agent: bot\nDisallow: /\nCrawl-delay: 7\nUser-agent: *\nAllow: /a/ok\nDisallow: /a\nSitemap: https://h.example.com/s.xml"


def test_robots(spark):
    table = spark.createDataFrame([("h.example.com", ROBOTS), ("e.example.com", ""), ("f.example.com", "User-agent: *\nDisallow:\n")], "domain string, raw_content string")
    p = {r.domain: r for r in robots.parsed(table).collect()}
    assert (p["h.example.com"].crawl_delay, p["h.example.com"].sitemaps, p["h.example.com"].disallowed) == (7.0, ["https://h.example.com/s.xml"], ["/", "/a"])
    assert p["e.example.com"].crawl_delay is None and p["e.example.com"].sitemaps == []
    urls = [f"https://{h}.example.com{x}" for h in "hefz" for x in ("/a/ok/1", "/a/x", "/z", "")]
    got = {r.url: r.allowed for r in robots.decisions(spark.createDataFrame([(u,) for u in urls], "url string"), table).collect()}
    parsers = {r.domain: RobotFileParser() for r in table.collect()}
    for r in table.collect():
        parsers[r.domain].parse(r.raw_content.splitlines())
    assert got == {u: parsers[d].can_fetch("*", u) if (d := u.split("/")[2]) in parsers else True for u in urls}
    assert {r.url: r.crawl_delay for r in robots.crawl_delay(spark.createDataFrame([(urls[0],), (urls[-1],)], "url string"), table).collect()} == {urls[0]: 7.0, urls[-1]: None}


def sequential(texts):
    """Greedy leaders in order of arrival."""
    kept, out = [], {}
    for i, t in texts:
        if len(t.strip()) < 50:
            out[i] = (False, None, "skipped_short_content")
            continue
        h, fp = " ".join(t.lower().split()), hashing.fingerprint(t)
        same = next((k for k, kh, _ in kept if kh == h), None)
        near = min(((bin((fp ^ f) & (1 << 64) - 1).count("1"), k) for k, _, f in kept), default=(99, None))
        if same is not None:
            out[i] = (True, same, "exact_hash")
        elif near[0] <= 9:
            out[i] = (True, near[1], "simhash")
        else:
            kept.append((i, h, fp))
            out[i] = (False, None, "unique")
    return out


def test_dedup_is_sequential(spark):
    rnd = random.Random(1)
    texts = []
    for i in range(25):
        words = [f"w{rnd.randrange(500)}" for _ in range(40)]
        for k in range(rnd.randrange(1, 7)):
            w = list(words)
            for _ in range(k):
                w[rnd.randrange(40)] = "changed"
            texts.append(" ".join(w))
    texts += ["short", "", texts[0].upper(), "  " + texts[3]]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.id: (r.is_duplicate, r.matching_id, r.method) for r in dedup.deduplicated(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == sequential(rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.id: (r.is_duplicate, r.matching_id, r.method) for r in dedup.deduplicated(docs).collect()}
    assert got == sequential(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_leaders_are_no_components(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "fp bigint, seq int")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "fp_a bigint, fp_b bigint")
    assert {r.fp: r.unique for r in dedup.leaders(nodes, edges).collect()} == {1: True, 2: False, 3: True}


@pytest.mark.parametrize("blocks", [None, 10, 11, 12, 13, 14])
def test_blocks_find_every_pair(spark, blocks):
    rnd = random.Random(2)
    prints = []
    for _ in range(60):
        a = rnd.getrandbits(64)
        b = a
        for k in rnd.sample(range(64), rnd.randrange(12)):
            b ^= 1 << k
        prints += [a, b]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    given = spark.createDataFrame([(p,) for p in [*signed, None]], "fp bigint")
    got = [(r.fp_a, r.fp_b) for r in dedup.near_pairs(given, blocks=blocks).collect()]
    want = {(x, y) for x in set(signed) for y in set(signed) if x < y and bin((x ^ y) & (1 << 64) - 1).count("1") <= 9}
    assert len(got) == len(set(got)) and set(got) == want


def test_more_prints_get_longer_keys():
    chosen = [dedup.blocks_for(10**k) for k in range(1, 10)]
    assert chosen == sorted(chosen) and chosen[0] == 10 and chosen[-1] == 14
    assert len(dedup.masks(12)) == 220


def test_delays(spark):
    events = [(200, True), (429, False), (500, False), (404, False), (404, False), (200, True), (200, True)]
    rows = [("d", i, i, 1.0, ok, status) for i, (status, ok) in enumerate(events)]
    log = spark.createDataFrame(rows, "domain string, ts bigint, seq bigint, response_time double, success boolean, status int")
    got = [r.delay for r in politeness.adaptive_delays(log, high=3.0).orderBy("seq").collect()]
    assert got == pytest.approx([0.95, 2.85, 3.0, 3.0, 3.0, 2.85, 2.7075])
    fixed = log.withColumn("crawl_delay", F.when(F.col("seq") == 6, 20.0))
    assert politeness.adaptive_delays(fixed).orderBy(F.desc("seq")).first().delay == pytest.approx(19.0)
    assert [r.consecutive_errors for r in politeness.with_error_runs(log).orderBy("seq").collect()] == [0, 1, 2, 3, 4, 0, 0]
    health = politeness.proxy_health(log.filter("seq < 5"))
    assert tuple(health.first()) == ("d", 1, 4, False, 1.0)
    assert politeness.least_used(politeness.proxy_health(log)).first().proxy == "d"


EDGES = [("http://s/", "http://s/a"), ("http://s/", "http://s/b"), ("http://s/a", "http://s/c"), ("http://s/b", "http://s/c"), ("http://s/c", "http://s/d"), ("http://s/a", "http://s/")]


def test_crawl_is_breadth_first(spark):
    edges = spark.createDataFrame([(a, b, True, i) for i, (a, b) in enumerate(EDGES)], "src string, dst string, is_internal boolean, pos int")
    start = spark.createDataFrame([("http://s/",)], "url string")
    got = {r.url: (r.depth, r.priority) for r in frontier.crawl(start, edges, max_depth=2).collect()}
    assert got == {"http://s/": (0, 0), "http://s/a": (1, 2), "http://s/b": (1, 2), "http://s/c": (2, 2)}
    edges.createOrReplaceTempView("edges")
    twin = spark.sql("WITH RECURSIVE r(url, depth) AS (SELECT 'http://s/', 0 UNION ALL SELECT dst, depth + 1 FROM r JOIN edges ON src = url WHERE depth < 2) SELECT url, min(depth) AS depth FROM r GROUP BY url")
    assert {r.url: r.depth for r in twin.collect()} == {u: d for u, (d, _) in got.items()}
    assert frontier.crawl(start, edges, max_depth=5, max_urls=3).count() == 3
    assert [r.url[-1] for r in frontier.next_batch(frontier.crawl(start, edges, max_depth=2), 9).collect()] == ["/", "a", "b", "c"]
    chain = spark.createDataFrame([(f"http://s/{i}", f"http://s/{i + 1}", True, 0) for i in range(12)], "src string, dst string, is_internal boolean, pos int")
    assert [r.seq for r in frontier.crawl(spark.createDataFrame([("http://s/0",)], "url string"), chain, max_depth=9).orderBy("depth").collect()] == list(range(1, 11))
    outside = edges.withColumn("is_internal", F.lit(False))
    assert frontier.crawl(start, outside, max_depth=3).count() == 1 and frontier.crawl(start, outside, max_depth=1, follow_external=True).filter("priority = 4").count() == 2


def test_crawl_over_a_corpus(spark):
    corpus = spark.createDataFrame([("http://s/", '<a href="/a">a</a><a href="/no">n</a><a href="http://t/">t</a>'), ("http://s/a", '<a href="/b#x">b</a>'), ("http://s/b", "")], "url string, html string")
    rules = spark.createDataFrame([("s", "User-agent: *\nDisallow: /b")], "domain string, raw_content string")
    got = {r.url: r.depth for r in pipeline.crawl(spark.createDataFrame([("http://s/",)], "url string"), corpus, rules, max_depth=4).collect()}
    assert got == {"http://s/": 0, "http://s/a": 1, "http://s/no": 1, "http://s/b": 2}
    f = {r.url: r for r in fetching.fetched(spark.createDataFrame([("http://s/",), ("http://x/",)], "url string"), corpus).collect()}
    assert f["http://s/"].success and f["http://x/"].status_code == 0 and f["http://x/"].error.startswith("Connection error")
    assert spark.range(1).select(fetching.profile(F.lit(8))).first()[0].platform == "Linux" and fetching.auth_headers("bearer", "t") == {"Authorization": "Bearer t"}


def test_scored_queue(spark):
    q = frontier.ScoredQueue(spark.createDataFrame([], "url string, score double"), spark.createDataFrame([], "url_hash string"))
    q = q.push(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0), ("c", 3.0)], "url string, score double"))
    assert [r.url for r in q.peek(2).collect()] == ["c", "b"]
    top, q = q.pop(2)
    assert [r.url for r in q.queue.collect()] == ["a"] and tuple(q.sizes().first()) == (1, 3)
    assert q.push(spark.createDataFrame([("b", 9.0)], "url string, score double")).queue.count() == 1
    assert q.mark_seen(spark.createDataFrame([("z",)], "url string")).seen.count() == 4 and q.clear().queue.count() == 0


def test_stores(spark, tmp_path):
    store = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "url string, v int, t string")
    new = spark.createDataFrame([("a", 2, "n"), ("c", 3, "n"), ("c", 4, "m"), ("", 9, "e"), (None, 9, "e")], "url string, v int, t string")
    assert {(r.url, r.v) for r in stores.insert_if_absent(store, new, "v").filter("url <> ''").collect()} == {("c", 3)}
    assert {(r.url, r.v) for r in stores.upsert(store, new, "v").collect()} == {("a", 2), ("b", 1), ("c", 4)}
    changes = spark.createDataFrame([("a", None, "q"), ("z", 1, "q")], "url string, v int, t string")
    assert {tuple(r) for r in stores.update(store, changes).collect()} == {("a", 1, "q"), ("b", 1, "y")}
    pages = spark.range(250).select(F.concat(F.lit("u"), F.lpad("id", 4, "0")).alias("url"))
    assert {(r.batch, r["count"], r.file) for r in stores.json_batches(pages, "url").collect()} == {(1, 100, "batch_0001.json"), (2, 100, "batch_0002.json"), (3, 50, "batch_0003.json")}
    stores.write_json_batches(pages, str(tmp_path / "out"), "url")
    back = {r.batch: [p.url for p in r.pages] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back[2] == [f"u{i:04d}" for i in range(100, 200)]
    stores.write_json_pages(pages.limit(3), str(tmp_path / "pages"))
    assert {r.file for r in spark.read.text(str(tmp_path / "pages")).select("file").distinct().collect()} == {r[0] for r in pages.limit(3).select(stores.single_file_name(F.col("url"))).collect()}
    assert stores.summary(pages, pages.limit(2), 5).first().pages_per_second == 50 and stores.output_stats(pages).first().pending == 50


@pytest.mark.parametrize("advisory,coalesce", [("64m", "true"), ("1m", "true"), ("64m", "false")])
def test_wide_rows_are_numbered_without_gaps(spark, tmp_path, advisory, coalesce):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for key, value in zip(before, ("13", advisory, coalesce)):
            spark.conf.set(key, value)
        pages = spark.range(8000).select(F.concat(F.lit("u"), F.lpad(F.pmod("id", F.lit(4000)), 5, "0")).alias("url"), "id", *(F.sha2(F.concat("id", F.lit(str(k))), 512).alias(f"c{k}") for k in range(16)))
        got = stores.numbered(pages, "url", 100).select("url", "place", "batch").collect()
        assert sorted(r.place for r in got) == list(range(1, 8001)) and len({r.batch for r in got}) == 80
        assert [r.url for r in sorted(got, key=lambda r: r.place)] == sorted(r.url for r in got)
        stores.write_json_batches(pages.select("url", "c0"), str(tmp_path / "out"), "url")
        assert spark.read.json(str(tmp_path / "out")).agg(F.count("*"), F.sum("count"), F.sum(F.size("pages"))).first()[:] == (80, 8000, 8000)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_several_changes_of_a_url_are_folded(spark):
    store = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "url string, v int, t string")
    changes = spark.createDataFrame([("a", 5, None, 3), ("a", 7, "first", 1), ("a", None, "second", 2)], "url string, v int, t string, at int")
    assert {tuple(r) for r in stores.update(store, changes, order="at").collect()} == {("a", 5, "second"), ("b", 1, "y")}
    assert stores.update(store, changes).count() == 2


def test_search(spark):
    pages = spark.createDataFrame([("a", "cats", "", "dogs"), ("b", "", None, "cats cats dogs"), ("c", "birds", "cats", "")], "url string, title string, description string, text_content string")
    assert [r.url for r in search.text_search(pages, "Cats", key="url", fields=("title", "text_content")).collect()] == ["a", "b"]
    got = search.ranked_search(pages, "cats", key="url").collect()
    assert [r.url for r in got] == ["a", "b", "c"] and got[0].score > got[1].score
    assert search.index(pages, key="url", field="text_content").filter("term = 'cats'").first().tf == 2
    assert search.get_page(pages, "b").count() == 1


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language.profiles(docs.filter("doc_id % 2 = 0"))
    tested = docs.filter("doc_id % 2 = 1 and n_chars > 60")
    got = language.detected(tested, known).join(docs, "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert got > 0.95
    assert language.detected(spark.createDataFrame([(1, "x"), (2, None)], "doc_id int, text string"), known).filter("source = 'insufficient_content'").count() == 2


def test_streams_equal_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"d{rnd.randrange(3)}", datetime(2024, 1, 1) + timedelta(minutes=i), i, 1.0, ok, 200 if ok else rnd.choice([404, 429, 500]), f"http://u/{rnd.randrange(20)}") for i in range(120) for ok in [rnd.random() < 0.6]]
    schema = "domain string, ts timestamp, seq bigint, response_time double, success boolean, status int, url string"
    log = spark.createDataFrame(rows, schema).coalesce(1)
    for k in range(3):
        log.filter(F.col("seq").between(40 * k, 40 * k + 39)).coalesce(1).write.parquet(str(tmp_path / "log"), mode="append")
    for key, value in stream.STATE_STORE.items():
        spark.conf.set(key, value)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    assert run(stream.first_seen(read(), "3 hours"), "first_seen", "append").count() == len({r[6] for r in rows})
    counts = run(stream.windowed_counts(read()), "windowed", "update").groupBy("domain", "start").agg(F.max("requests").alias("n"))
    assert counts.agg(F.sum("n")).first()[0] == 120
    last = run(stream.delays(read()), "delays", "update").toPandas().groupby("domain").delay.last().to_dict()
    batch = politeness.adaptive_delays(log).groupBy("domain").agg(F.max_by("delay", F.struct("ts", "seq")).alias("delay"))
    assert last == pytest.approx({r.domain: round(r.delay, 6) for r in batch.collect()})
