"""Queries of robots rules, the frontier, queues, stores and summaries, each with its SQL; what the tables lack is made of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import hashing, markup, text, urls
from .operators import entities, frontier, robots, search
from .queries import _EDGES, _HOST, _t, ORACLES, query
from .sources import fetching, stores

#: Robots files that a host gets by the length of its name; the third isn't found.
ROBOTS = (
    "User-agent: *\nDisallow: /en\nAllow: /\nCrawl-delay: 7\nSitemap: https://s.example.com/x.xml",
    "User-agent: bot\nDisallow: /\n\nUser-agent: *\nAllow: /de\nDisallow: /d\nDisallow: /f # and below",
    "User-agent: *\nDisallow: /",
)
_PATHS = f"""u AS (SELECT DISTINCT url, {_HOST.format("url")} AS host FROM pages),
t AS (SELECT url, length(host) % 3 AS kind, CASE regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) END AS path FROM u)"""


def _robots(pages: DataFrame) -> DataFrame:
    hosts = pages.select(urls.netloc(F.col("url")).alias("domain")).distinct()
    kind = F.pmod(F.length("domain"), F.lit(3))
    raw = F.get(F.array(*map(F.lit, ROBOTS)), kind)
    return hosts.select("domain", robots.usable(raw, F.when(kind == 2, 404).otherwise(200)).alias("raw_content"))


@query(
    "robots_decisions",
    f"""WITH {_PATHS} SELECT url, CASE kind WHEN 0 THEN NOT starts_with(path, '/en')
  WHEN 1 THEN starts_with(path, '/de') OR NOT (starts_with(path, '/d') OR starts_with(path, '/f')) ELSE true END AS allowed FROM t""",
)
def robots_decisions(spark, d):
    pages = _t(spark, d, "pages")
    return robots.decisions(pages, _robots(pages))


@query("robots_delays", f"WITH {_PATHS} SELECT p.url, CASE WHEN kind = 0 THEN 7.0::DOUBLE END AS crawl_delay, CASE WHEN kind = 0 THEN 'https://s.example.com/x.xml' ELSE '' END AS sitemaps FROM pages p JOIN t USING (url)")
def robots_delays(spark, d):
    pages = _t(spark, d, "pages")
    return robots.crawl_delay(pages, _robots(pages)).withColumn("sitemaps", F.array_join("sitemaps", ","))


@query("robots_paths", f"WITH {_PATHS}, h AS (SELECT DISTINCT host AS domain FROM u) SELECT domain, CASE length(domain) % 3 WHEN 0 THEN '/' WHEN 1 THEN '/de' ELSE '' END AS allowed, CASE length(domain) % 3 WHEN 0 THEN '/en' WHEN 1 THEN '/,/d,/f # and below' ELSE '' END AS disallowed FROM h")
def robots_paths(spark, d):
    found = robots.parsed(_robots(_t(spark, d, "pages")))
    return found.select("domain", *(F.array_join(c, ",").alias(c) for c in ("allowed", "disallowed")))


def _tree(docs: DataFrame) -> DataFrame:
    """Links of a site whose page n links to 2n and 2n + 1, for every document."""
    url = lambda c: F.concat(F.lit("https://h.example.com/"), c.cast("string"))
    pages = docs.select((F.col("doc_id") + 1).alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    return pages.select(url(F.col("n")).alias("src"), url(F.col("n") * 2 + F.col("pos")).alias("dst"), F.lit(True).alias("is_internal"), "pos")


@query("frontier_crawl", "SELECT 'https://h.example.com/' || n AS url, floor(log2(n))::INT AS depth, n AS seq, CASE WHEN n > 1 THEN 'https://h.example.com/' || n // 2 END AS parent_url FROM range(1, 64) t(n)")
def frontier_crawl(spark, d):
    """Five waves from page 1 over the links of all documents' pages: every page comes at its depth and in its order."""
    start = spark.createDataFrame([("https://h.example.com/1",)], "url string")
    return frontier.crawl(start, _tree(_t(spark, d, "documents")), max_depth=5).select("url", "depth", "seq", "parent_url")


@query("frontier_skipped", f"WITH {_EDGES} SELECT count(*) AS duplicates_skipped FROM edges WHERE md5(lower(dst)) IN (SELECT md5(lower(url)) FROM pages)")
def frontier_skipped(spark, d):
    pages = _t(spark, d, "pages")
    start = frontier.seeds(pages.select("url").distinct())
    return frontier.skipped(frontier.expanded(start, markup.link_edges(pages)), start)


@query("frontier_next", "SELECT md5(text) AS url, doc_id AS seq FROM documents ORDER BY doc_id % 5, n_chars % 4, doc_id LIMIT 25")
def frontier_next(spark, d):
    rows = _t(spark, d, "documents").select(F.md5("text").alias("url"), (F.col("doc_id") % 5).alias("priority"), (F.col("n_chars") % 4).alias("depth"), F.col("doc_id").alias("seq"))
    return frontier.next_batch(rows, 25).select("url", "seq")


@query("frontier_stats", "SELECT (SELECT count(*) FROM documents) AS queue_size, (SELECT count(*) FROM pages) AS seen, (SELECT count(*) FROM labels) AS crawled, (SELECT count(*) FROM benchmark) AS failed")
def frontier_stats(spark, d):
    return frontier.stats(*(_t(spark, d, t) for t in ("documents", "pages", "labels", "benchmark")))


def _queue(spark, d) -> frontier.ScoredQueue:
    items = _t(spark, d, "documents").select(F.col("source").alias("url"), F.col("n_chars").cast("double").alias("score"))
    empty = frontier.ScoredQueue(spark.createDataFrame([], "url string, score double"), spark.createDataFrame([], "url_hash string"))
    return empty.push(items).push(items)


@query("queue_pop", "SELECT source AS url, max(n_chars)::DOUBLE AS score FROM documents GROUP BY source ORDER BY 2 DESC, 1 DESC LIMIT 3")
def queue_pop(spark, d):
    return _queue(spark, d).pop(3)[0]


@query("queue_sizes", "SELECT greatest(count(DISTINCT source) - 3, 0) AS size, count(DISTINCT source) AS seen FROM documents")
def queue_sizes(spark, d):
    return _queue(spark, d).pop(3)[1].sizes()


@query(
    "social_links",
    """SELECT url, e.pos, e.platform, e.link FROM pages, LATERAL (SELECT * FROM (VALUES (0, 'twitter', 'https://twitter.com/u' || page_id), (1, 'twitter', 'https://www.x.com/b'), (3, 'github', 'http://GitHub.com/' || page_id || '/r')) v(pos, platform, link)) e""",
)
def social_links(spark, d):
    one = F.concat(F.lit("https://twitter.com/u"), "page_id")
    hrefs = F.array(one, F.lit(" https://www.x.com/b "), F.lit("/twitter.com/no"), F.concat(F.lit("http://GitHub.com/"), "page_id", F.lit("/r")), F.lit("https://example.com/none"), one)
    return entities.social_links(_t(spark, d, "pages").select("url", hrefs.alias("hrefs")))


@query("raw_fingerprints", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE md5(text) END AS content_hash, length(coalesce(text, ''))::INT AS text_length FROM documents")
def raw_fingerprints(spark, d):
    return hashing.fingerprints(_t(spark, d, "documents"), url="doc_id").select(F.col("url").alias("doc_id"), "content_hash", "text_length")


@query(
    "html_summaries",
    f"""WITH s AS ({ORACLES["summaries"]}), f AS (SELECT doc_id, substr(list_filter(string_split(text, chr(10)), lambda p: length(p) > 50)[1], 1, 500) AS first FROM documents)
SELECT doc_id, CASE WHEN first IS NULL THEN method ELSE 'first_paragraph' END AS method, coalesce(first, summary) AS summary FROM s JOIN f USING (doc_id)""",
)
def html_summaries(spark, d):
    """The lines of a document as its paragraphs."""
    docs = _t(spark, d, "documents").withColumn("paragraphs", F.split("text", "\n"))
    return text.html_summaries(docs, key="doc_id")


@query(
    "repeated_updates",
    """WITH c AS (SELECT user_id AS url, event_id AS seq, event_type AS kind, CASE WHEN event_type <> 'view' THEN value END AS value FROM events)
SELECT s.url, coalesce(f.kind, 'none') AS kind, coalesce(f.value, -1.0) AS value FROM (SELECT DISTINCT user_id AS url FROM events UNION SELECT -5) s
LEFT JOIN (SELECT url, arg_max(kind, seq) AS kind, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value FROM c GROUP BY url) f USING (url)""",
)
def repeated_updates(spark, d):
    """Every event as a partial update of its user's row."""
    events = _t(spark, d, "events")
    users = events.select(F.col("user_id").alias("url")).distinct().unionByName(spark.createDataFrame([(-5,)], "url bigint"))
    store = users.select("url", F.lit("none").alias("kind"), F.lit(-1.0).alias("value"))
    changes = events.select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return stores.update(store, changes, order="seq")


@query("wide_batches", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, ((row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1)::INT AS batch, md5(text) AS text_md5 FROM documents")
def wide_batches(spark, d):
    """The place and batch of whole rows with their texts."""
    return stores.numbered(_t(spark, d, "documents"), "doc_id").select("doc_id", F.col("place").cast("bigint").alias("place"), "batch", F.md5("text").alias("text_md5"))


@query("crawl_summary", "SELECT *, 4.0::DOUBLE AS duration_seconds, round(pages_crawled / 4.0, 6)::DOUBLE AS pages_per_second FROM (SELECT (SELECT count(*) FROM pages) AS pages_crawled, (SELECT count(*) FROM events WHERE event_type = 'error') AS pages_failed)")
def crawl_summary(spark, d):
    return stores.summary(_t(spark, d, "pages"), _t(spark, d, "events").filter("event_type = 'error'"), 4.0)


@query(
    "fetched_links",
    f"""WITH {_EDGES}, w AS (SELECT DISTINCT dst AS url FROM edges UNION SELECT url FROM pages)
SELECT w.url, CASE WHEN p.url IS NULL THEN 0 ELSE 200 END AS status_code, coalesce(strlen(p.html), 0)::INT AS content_length, p.url IS NOT NULL AS success, CASE WHEN p.url IS NULL THEN 'Connection error: not in the corpus' END AS error, {_HOST.format("w.url")} AS domain FROM w LEFT JOIN pages p ON p.url = w.url""",
)
def fetched_links(spark, d):
    """Every page and link target as fetched from the corpus."""
    pages = _t(spark, d, "pages")
    wanted = pages.select("url").unionByName(markup.link_edges(pages).select(F.col("dst").alias("url"))).distinct()
    return fetching.fetched(wanted, pages).select("url", "status_code", "content_length", "success", "error", "domain")


@query("page_by_url", "SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages)")
def page_by_url(spark, d):
    pages = _t(spark, d, "pages")
    return search.get_page(pages, pages.agg(F.min("url")).first()[0]).select("page_id", "url")
