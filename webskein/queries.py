"""The library's queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, markup, text, urls
from .operators import classify, dedup, dom, entities, frontier, language, politeness, search
from .plans import pipeline
from .session import spread
from .sources import stores

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SEARCH = "thing edea haner"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def request_log(events: DataFrame) -> DataFrame:
    """The events as a request log: a user is a domain, an error event a failed request."""
    failed = F.col("event_type") == "error"
    status = F.when(failed, F.when(F.col("event_id") % 3 == 0, 429).when(F.col("event_id") % 3 == 1, 500).otherwise(404)).otherwise(200)
    return events.select(F.col("user_id").cast("string").alias("domain"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("response_time"), (~failed).alias("success"), status.alias("status"))


_LOG = """log AS (SELECT user_id::VARCHAR AS domain, ts, event_id AS seq, value AS response_time, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 500 ELSE 404 END ELSE 200 END AS status FROM events)"""
_RUNS = f"""{_LOG},
isl AS (SELECT *, sum(success::INT) OVER (PARTITION BY domain ORDER BY ts, seq) AS island FROM log),
runs AS (SELECT * EXCLUDE island, sum((NOT success)::INT) OVER (PARTITION BY domain, island ORDER BY ts, seq)::BIGINT AS consecutive_errors FROM isl)"""
_UNESCAPE = "{}"
for _name, _char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", "\u00a0"), ("&amp;?", "&")):
    _UNESCAPE = f"regexp_replace({_UNESCAPE}, '{_name}', '{_char}', 'g')"
_HOST = "lower(regexp_extract({0}, '^https?://([^/?#]*)', 1))"
_LAST2 = "array_to_string(list_slice(string_split(" + _HOST + ", '.'), -2, -1), '.')"


# pages


@query("page_lang_counts", "SELECT lower(split_part(regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1), '-', 1)) AS language, count(*) AS pages FROM pages GROUP BY 1")
def page_lang_counts(spark, d):
    return _t(spark, d, "pages").groupBy(markup.primary_lang(F.col("html")).alias("language")).agg(F.count("*").alias("pages"))


@query("page_titles", f"SELECT page_id, {_UNESCAPE.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS title FROM pages")
def page_titles(spark, d):
    return _t(spark, d, "pages").select("page_id", markup.title(F.col("html")).alias("title"))


@query("page_charset", "SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta charset=\"?([^\"> ]+)', 1), ''), 'utf-8') AS charset FROM pages")
def page_charset(spark, d):
    return _t(spark, d, "pages").select("page_id", markup.charset(F.col("html")).alias("charset"))


_TRACKED = ", ".join(f"'{p}'" for p in urls.TRACKING)


@query(
    "url_normalized",
    f"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || {_HOST.format('url')}
  || coalesce(nullif(rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), ''), '/')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS normalized
FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({_TRACKED}))) AS q FROM pages)""",
)
def url_normalized(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.normalize(F.col("url"), F.lit(None).cast("string")).alias("normalized"))


@query("url_hashes", "SELECT page_id, md5(lower(trim(url))) AS url_hash, regexp_extract(url, '//([^/?#]*)', 1) AS netloc, 'page_' || substr(md5(url), 1, 12) || '.json' AS file FROM pages")
def url_hashes(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", urls.url_hash(u).alias("url_hash"), urls.netloc(u).alias("netloc"), stores.single_file_name(u).alias("file"))


@query("url_domain_counts", f"SELECT {_LAST2.format('url')} AS domain, count(*) AS pages, count(DISTINCT {_HOST.format('url')}) AS hosts FROM pages GROUP BY 1")
def url_domain_counts(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").groupBy(urls.domain(u).alias("domain")).agg(F.count("*").alias("pages"), F.countDistinct(urls.subdomain(u)).alias("hosts"))


@query(
    "url_extension_types",
    """SELECT ext AS extension, CASE WHEN ext = '' THEN 'Unknown' ELSE upper(substr(ext, 2)) END AS file_type, ext IN ('', '.html', '.htm', '.php', '.asp', '.aspx', '.jsp') AS is_webpage,
  CASE WHEN ext = '.html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime, count(*) AS pages
FROM (SELECT lower(regexp_extract(rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '[^/.][^/]*([.][^./]+)$', 1)) AS ext FROM pages) GROUP BY ALL""",
)
def url_extension_types(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").groupBy(urls.extension(u).alias("extension"), urls.file_type(u).alias("file_type"), urls.is_webpage(u).alias("is_webpage"), urls.mime_type(u).alias("mime")).agg(F.count("*").alias("pages"))


_EDGES = """raw AS (SELECT url AS src, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT url, regexp_extract_all(html, '<a href="([^"> ]+)', 1) AS hs FROM pages)),
enc AS (SELECT src, pos, regexp_extract(src, '^https?://[^/?#]*', 0) || coalesce(nullif(rtrim(replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%21', '!'), '%26', '&'), '/'), ''), '/') AS dst FROM raw WHERE href NOT LIKE '#%'),
edges AS (SELECT src, min(pos)::INT AS pos, lower(regexp_extract(dst, '^https?://[^/?#]*', 0)) || regexp_extract(dst, '^https?://[^/?#]*(.*)$', 1) AS dst FROM enc GROUP BY src, 3)"""


@query("links_edges", f"WITH {_EDGES} SELECT src, pos, dst, true AS is_internal FROM edges")
def links_edges(spark, d):
    return markup.link_edges(_t(spark, d, "pages"))


@query("links_internal_external", f"WITH {_EDGES} SELECT src, count(*) AS internal, 0::BIGINT AS external FROM edges GROUP BY src")
def links_internal_external(spark, d):
    return markup.link_edges(_t(spark, d, "pages")).groupBy("src").agg(F.count_if("is_internal").alias("internal"), F.count_if(~F.col("is_internal")).alias("external"))


def _clean_sql() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<div class=\"ad\"[^<]*</div>', ' ', 'g')"
    return f"trim(regexp_replace({_UNESCAPE.format(f"regexp_replace({out}, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))"


@query("page_clean_text", f"SELECT page_id, {_clean_sql()} AS text FROM pages")
def page_clean_text(spark, d):
    return _t(spark, d, "pages").select("page_id", markup.clean_text(F.col("html")).alias("text"))


@query("page_needs_js", "SELECT page_id, length(html) < 1000 OR NOT contains(html, '<a') AS needs_js FROM pages")
def page_needs_js(spark, d):
    return _t(spark, d, "pages").select("page_id", markup.needs_javascript(F.col("html")).alias("needs_js"))


def _blocked_sql() -> str:
    early = "WHEN status = 403 THEN '403_forbidden' WHEN status = 429 THEN '429_rate_limited'"
    plain = " ".join(f"WHEN contains(lower(substr(html, 1, 5000)), '{s}') THEN 'blocked_indicator: {s}'" for s in markup.BLOCKED)
    rendered = " ".join(f"WHEN contains(lower(substr(html, 1, 10000)), '{s}') THEN '{r}'" for s, r in markup.BLOCKED_RENDERED)
    return f"""SELECT page_id, CASE {early} WHEN status = 503 THEN 'cloudflare_challenge' {plain} END AS reason, CASE {early} {rendered} END AS reason_rendered
FROM (SELECT *, CASE page_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS status FROM pages)"""


@query("page_blocked", _blocked_sql())
def page_blocked(spark, d):
    m = F.col("page_id") % 7
    status = F.when(m == 0, 403).when(m == 1, 429).when(m == 2, 503).otherwise(200)
    html = F.col("html")
    return _t(spark, d, "pages").select("page_id", markup.blocked_reason(html, status, F.lit("Cloudflare")).alias("reason"), markup.blocked_reason_rendered(html, status).alias("reason_rendered"))


def _class_sql() -> str:
    scores = []
    for kind, (tags, classes, _, _) in classify.SIGNALS.items():
        parts = [f"CASE WHEN regexp_matches(h, '<{t}[\\s/>]') THEN 10 ELSE 0 END" for t in tags.split()]
        for c in classes.split():
            parts.append(f"CASE WHEN contains(h, 'class=\"{c}\"') OR contains(h, 'class=''{c}''') THEN 5 ELSE 0 END + CASE WHEN contains(h, 'id=\"{c}\"') OR contains(h, 'id=''{c}''') THEN 5 ELSE 0 END")
            parts.append(f"CASE WHEN contains(h, '{c}') THEN 2 ELSE 0 END + CASE WHEN contains(u, '{c}') THEN 3 ELSE 0 END")
        scores.append(f"SELECT page_id, {classify.TYPES.index(kind)} AS place, '{kind}' AS type, {' + '.join(parts)} AS tenths FROM p")
    return f"""WITH p AS (SELECT page_id, lower(html) AS h, lower(url) AS u FROM pages), s AS ({' UNION ALL '.join(scores)}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tenths DESC, place) AS k FROM s), c AS (SELECT page_id, CASE WHEN tenths >= 10 THEN type ELSE 'unknown' END AS type, least(tenths / 100, 1.0)::DOUBLE AS confidence FROM r WHERE k = 1)"""


@query("page_classification", f"{_class_sql()} SELECT * FROM c")
def page_classification(spark, d):
    c = classify.classification(F.col("html"), F.col("url"))
    return spread(_t(spark, d, "pages")).select("page_id", c.alias("c")).select("page_id", "c.type", "c.confidence")


@query("classification_counts", f"{_class_sql()} SELECT type, count(*) AS pages FROM c GROUP BY type")
def classification_counts(spark, d):
    return page_classification(spark, d).groupBy("type").agg(F.count("*").alias("pages"))


_PAGES = "p AS (SELECT page_id, url, regexp_extract(url, '//([^/?#]*)', 1) AS domain FROM pages)"


def _stored(spark, d):
    return _t(spark, d, "pages").select("page_id", "url", urls.netloc(F.col("url")).alias("domain"))


@query("pages_by_domain", f"WITH {_PAGES} SELECT page_id, url FROM p WHERE domain = 'ththre.example.com' ORDER BY url LIMIT 100")
def pages_by_domain(spark, d):
    return search.pages_by_domain(_stored(spark, d), "ththre.example.com").select("page_id", "url")


@query("page_lookup", f"WITH {_EDGES}, w AS (SELECT url FROM pages UNION SELECT dst FROM edges) SELECT url FROM w WHERE url IN (SELECT url FROM pages)")
def page_lookup(spark, d):
    pages = _t(spark, d, "pages")
    wanted = pages.select("url").unionByName(markup.link_edges(pages).select(F.col("dst").alias("url"))).distinct()
    return search.page_exists(pages, wanted)


@query("page_count", "SELECT count(*) AS pages FROM pages")
def page_count(spark, d):
    return search.count_pages(_t(spark, d, "pages"))


@query("domain_facets", f"WITH {_PAGES} SELECT domain, count(*) AS n FROM p GROUP BY domain")
def domain_facets(spark, d):
    return search.facets(_stored(spark, d), "domain")


@query("frontier_wave", f"WITH {_EDGES} SELECT dst AS url, 2 AS priority, 1 AS depth, min(src) AS parent_url FROM edges WHERE md5(lower(dst)) NOT IN (SELECT md5(lower(url)) FROM pages) GROUP BY dst")
def frontier_wave(spark, d):
    pages = _t(spark, d, "pages")
    start = frontier.seeds(pages.select("url").distinct())
    found = frontier.expanded(start, markup.link_edges(pages)).groupBy("url", "url_hash", "priority", "depth").agg(F.min("parent_url").alias("parent_url"))
    return found.join(start.select("url_hash"), "url_hash", "left_anti").select("url", "priority", "depth", "parent_url")


@query("seen_antijoin", f"WITH {_EDGES}, w AS (SELECT url FROM pages UNION SELECT dst FROM edges) SELECT url, md5(lower(trim(url))) IN (SELECT md5(lower(trim(url))) FROM pages) AS is_seen FROM w")
def seen_antijoin(spark, d):
    pages = _t(spark, d, "pages")
    wanted = pages.select("url").unionByName(markup.link_edges(pages).select(F.col("dst").alias("url"))).distinct()
    return frontier.is_seen(wanted, pages.select(urls.url_hash(F.col("url")).alias("url_hash")))


@query("failed_urls", f"WITH {_EDGES} SELECT md5(lower(dst)) AS url_hash, count(*) AS failures, count(*) < 3 AS retry FROM edges GROUP BY 1")
def failed_urls(spark, d):
    """Every link as a failed try of its target."""
    return frontier.failures(markup.link_edges(_t(spark, d, "pages")).select(F.col("dst").alias("url")))


@query("json_batches", "SELECT batch, count(*) AS count, printf('batch_%04d.json', batch) AS file FROM (SELECT ((row_number() OVER (ORDER BY page_id) - 1) // 100 + 1)::INT AS batch FROM pages) GROUP BY batch")
def json_batches(spark, d):
    return stores.json_batches(_t(spark, d, "pages").select("page_id"), "page_id")


@query("output_stats", "SELECT count(*) AS total_pages, count(*) // 100 AS batches_written, count(*) % 100 AS pending FROM pages")
def output_stats(spark, d):
    return stores.output_stats(_t(spark, d, "pages"))


@query("upsert_last_wins", "SELECT source AS url, max(doc_id) AS version FROM documents GROUP BY source")
def upsert_last_wins(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("url"), F.col("doc_id").alias("version"))
    store = _t(spark, d, "documents").filter("lang = 'en'").select(F.col("source").alias("url"), F.col("doc_id").alias("version"))
    return stores.upsert(store, rows, "version")


@query("insert_first_wins", "SELECT source AS url, min(doc_id) AS version FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source LIKE '%1%') GROUP BY source")
def insert_first_wins(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("url"), F.col("doc_id").alias("version"))
    return stores.insert_if_absent(rows.filter("url LIKE '%1%'"), rows, "version")


@query("partial_update", "SELECT d.doc_id AS url, coalesce(l.quality, 9) AS quality, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1")
def partial_update(spark, d):
    store = _t(spark, d, "documents").select(F.col("doc_id").alias("url"), F.lit(9).alias("quality"), "lang")
    changes = _t(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("url"), "quality")
    return stores.update(store, changes)


@query(
    "url_similarity_pairs",
    f"""WITH p AS (SELECT page_id, url, {_HOST.format('url')} AS host, string_split(trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '/') AS s FROM pages)
SELECT a.page_id, b.page_id AS other_id, CASE WHEN a.url = b.url THEN 1.0 WHEN a.host <> b.host THEN 0.0 ELSE len(list_filter(range(1, least(len(a.s), len(b.s)) + 1), lambda i: a.s[i] = b.s[i])) / greatest(len(a.s), len(b.s)) END::DOUBLE AS similarity
FROM p a JOIN p b ON b.page_id = a.page_id + 1 OR b.page_id = a.page_id + 7""",
)
def url_similarity_pairs(spark, d):
    a = _t(spark, d, "pages").select("page_id", "url", F.explode(F.array(F.col("page_id") + 1, F.col("page_id") + 7)).alias("other_id"))
    b = _t(spark, d, "pages").select(F.col("page_id").alias("other_id"), F.col("url").alias("other"))
    return a.join(b, "other_id").select("page_id", "other_id", urls.similarity(F.col("url"), F.col("other")).alias("similarity"))


_ORIGIN = "regexp_extract(url, '^https?://[^/?#]*', 0)"
#: What the made pages have in their head and body besides the given ones; {n} is the page's number.
HEAD = (
    '<meta name="Description" content=" About {n} "><meta name="author" content="A &amp; {n}"><meta property="keywords" content="one, two ,,{n}">'
    '<link rel="canonical" href="https://h.example.com/{n}"><link rel="shortcut icon" href="/f{n}.ico"><meta property="og:type" content="article">'
    '<meta property="og:image" content="/i{n}.png"><meta name="twitter:card" content="c{n}"><meta name="Generator" content="g{n}"><meta name="robots" content="noindex">'
)
BODY = (
    '<img src="/a{n}.png" data-srcset="/b.png 2x" alt=" x " width="10px"><img src="/never.png"><video src="/v{n}.mp4" poster="p.jpg"></video>'
    '<iframe src="https://www.youtube.com/embed/{n}" title="T"></iframe><iframe src="https://other.example.com/"></iframe><a href="/d{n}.pdf">d</a><a href="/d{n}.pdf">again</a>'
    '<script type="application/ld+json">{"@type": "Thing", "n": {n}}</script><div itemscope itemtype="https://schema.org/Person"><b itemprop="name">N{n}</b></div>'
    "<address>Street {n}, Town</address>"
)


def _made_pages(spark, d) -> DataFrame:
    """The pages; those with an odd number have HEAD and BODY too, the latter in front, as some pages break off."""
    pages = _t(spark, d, "pages")
    filled = lambda s: F.replace(F.lit(s), F.lit("{n}"), F.col("page_id").cast("string"))
    more = F.replace(F.replace("html", F.lit("</head>"), F.concat(filled(HEAD), F.lit("</head>"))), F.lit("<body>"), F.concat(F.lit("<body>"), filled(BODY)))
    return pages.withColumn("html", F.when(F.col("page_id") % 2 == 1, more).otherwise(F.col("html")))


def _as_json(*names: str) -> list:
    return [F.to_json(n).alias(n) for n in names]


@query(
    "page_metadata",
    f"""SELECT page_id, {_UNESCAPE.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS title, CASE WHEN odd THEN 'About ' || page_id ELSE '' END AS description, CASE WHEN odd THEN 'A & ' || page_id ELSE '' END AS author,
  CASE WHEN odd THEN 'noindex' ELSE '' END AS robots, CASE WHEN odd THEN '["one","two","' || page_id || '"]' ELSE '[]' END AS keywords, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset,
  CASE WHEN odd THEN 'https://h.example.com/' || page_id ELSE '' END AS canonical_url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, CASE WHEN odd THEN '/f' || page_id || '.ico' ELSE '' END AS favicon,
  CASE WHEN odd THEN '{{"type":"article","image":"/i' || page_id || '.png"}}' ELSE '{{}}' END AS og, CASE WHEN odd THEN '{{"card":"c' || page_id || '"}}' ELSE '{{}}' END AS twitter,
  CASE WHEN odd THEN '{{"generator":"g' || page_id || '"}}' ELSE '{{}}' END AS other_meta FROM (SELECT *, page_id % 2 = 1 AS odd FROM pages)""",
)
def page_metadata(spark, d):
    """Metadata of the made pages; lists and maps as JSON."""
    found = dom.extracted(_made_pages(spark, d), fields=("title", "description", "author", "robots", "keywords", "charset", "canonical_url", "language", "favicon", "og", "twitter", "other_meta"), keep=("page_id",))
    return found.select("page_id", "title", "description", "author", "robots", "charset", "canonical_url", "language", "favicon", *_as_json("keywords", "og", "twitter", "other_meta"))


@query(
    "page_media",
    f"""SELECT page_id, CASE WHEN odd THEN '[{{"url":"' || o || '/a' || page_id || '.png","alt":"x","title":"","width":10,"format":"PNG"}}]' ELSE '[]' END AS images,
  CASE WHEN odd THEN '[{{"url":"' || o || '/v' || page_id || '.mp4","type":"html5","source":"self-hosted","poster":"p.jpg","title":""}},{{"url":"https://www.youtube.com/embed/' || page_id || '","type":"iframe","source":"youtube","poster":"","title":"T"}}]' ELSE '[]' END AS videos,
  CASE WHEN odd THEN '[{{"url":"' || o || '/d' || page_id || '.pdf","file_type":"PDF Document","filename":"d' || page_id || '.pdf"}}]' ELSE '[]' END AS files,
  CASE WHEN odd THEN 'json-ld Thing {{"@type": "Thing", "n": ' || page_id || '}} microdata Person {{"@type": "https://schema.org/Person", "name": "N' || page_id || '"}}' ELSE '' END AS structured,
  CASE WHEN odd THEN '["Street ' || page_id || ', Town"]' ELSE '[]' END AS addresses FROM (SELECT *, page_id % 2 = 1 AS odd, {_ORIGIN} AS o FROM pages)""",
)
def page_media(spark, d):
    """Media, files, structured data and addresses of the made pages; lists as JSON."""
    found = dom.extracted(_made_pages(spark, d), fields=("images", "videos", "files", "structured", "addresses"), keep=("page_id",))
    items = F.array_join(F.transform("structured", lambda i: F.concat_ws(" ", i["format"], i["type"], i["data"])), " ")
    return found.select("page_id", *_as_json("images", "videos", "files", "addresses"), items.alias("structured"))


@query("page_main_content", f"SELECT page_id, {_clean_sql()} AS text FROM pages")
def page_main_content(spark, d):
    """The text that is left of the parsed pages without boilerplate."""
    return dom.extracted(_t(spark, d, "pages"), fields=("text",), keep=("page_id",)).drop("url")


_WRAPPED = """(SELECT page_id, md5(url) || ' ' || md5(html) AS a, md5(html) || ', ' || md5(url) AS b FROM pages)"""


@query(
    "made_main_content",
    f"""SELECT page_id, '<article data-x="1"><p class="a">' || a || '</p><p>' || b || '<br></p></article>' AS main_content, a || '|' || b AS paragraphs,
  '<html><body><article><p>' || a || '</p><p>' || b || '<br></p></article><div><p>short <a href="/">x</a></p></div></body></html>' AS cleaned_html FROM {_WRAPPED}""",
)
def made_main_content(spark, d):
    """The main element, cleaned HTML and paragraphs of a small page made of each page's checksums."""
    u, h = F.md5("url"), F.md5("html")
    html = F.concat(
        F.lit('<html><body><nav><a href="/">home</a></nav><div id="sidebar">S</div><div class="x share">S</div><article data-x="1"><p class="a">'), u, F.lit(" "), h, F.lit("</p><p>"), h, F.lit(", "), u,
        F.lit('<br></p></article><div class="end"><p>short <a href="/">x</a></p></div><p role="banner">B</p><footer>f</footer><script>var a</script></body></html>'),
    )
    found = dom.extracted(_t(spark, d, "pages").select("page_id", "url", html.alias("html")), fields=("main_content", "cleaned_html", "paragraphs"), keep=("page_id",))
    return found.select("page_id", "main_content", "cleaned_html", F.array_join("paragraphs", "|").alias("paragraphs"))


def _grams_sql(table: str) -> str:
    chars = f"(SELECT *, string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM {table})"
    return f"(SELECT * EXCLUDE c, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM {chars})"


def _detected_sql(rows: str) -> str:
    """Common tables up to `detected` (key, language, confidence, source) of the rows (key, text)."""
    return f"""counted AS (SELECT lang, gram, count(*) AS n FROM {_grams_sql("documents")} WHERE lang IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS k FROM counted),
profile AS (SELECT lang, gram, n / total AS p FROM ranked WHERE k <= 300),
given AS ({rows}),
enough AS (SELECT key, text FROM given WHERE length(trim(text, ' ')) >= 20),
own AS (SELECT key, gram, count(*) AS n FROM {_grams_sql("enough")} GROUP BY ALL),
scored AS (SELECT key, lang, sum(own.n * ln(p * 10000)) AS score FROM own JOIN profile USING (gram) GROUP BY ALL),
weighed AS (SELECT *, exp((score - max(score) OVER (PARTITION BY key)) / 20) AS w FROM scored),
best AS (SELECT key, arg_max(lang, w) AS lang, max(w) / sum(w) AS share FROM weighed GROUP BY key),
detected AS (SELECT given.key, coalesce(best.lang, 'unknown') AS language, round(coalesce(share, 0.0), 4) AS confidence,
  CASE WHEN best.key IS NOT NULL THEN 'profile' WHEN enough.key IS NOT NULL THEN 'detection_failed' ELSE 'insufficient_content' END AS source FROM given LEFT JOIN best USING (key) LEFT JOIN enough USING (key))"""


@query(
    "page_languages",
    f"""WITH {_detected_sql(f"SELECT page_id AS key, {_clean_sql()} AS text FROM pages WHERE page_id % 3 <> 0")}
SELECT url, CASE WHEN page_id % 3 = 0 THEN lower(split_part(regexp_extract(html, '<html lang="([^"]*)"', 1), '-', 1)) ELSE d.language END AS language, CASE WHEN page_id % 3 = 0 THEN 1.0 ELSE d.confidence END AS confidence,
  CASE WHEN page_id % 3 = 0 THEN 'html_attribute' ELSE d.source END AS source FROM pages LEFT JOIN detected d ON key = page_id""",
)
def page_languages(spark, d):
    """Languages of all pages; two in three are made to declare none, so that theirs is detected."""
    pages, docs = _t(spark, d, "pages"), _t(spark, d, "documents")
    pages = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.regexp_replace("html", "<html[^>]*>", "<html>")))
    return language.page_languages(pages, language.profiles(docs)).withColumn("confidence", F.round("confidence", 4))


@query("document_languages", f"WITH {_detected_sql("SELECT doc_id AS key, coalesce(text, '') AS text FROM documents")} SELECT key AS doc_id, language, confidence, source FROM detected")
def document_languages(spark, d):
    docs = _t(spark, d, "documents")
    return language.detected(docs, language.profiles(docs)).select("doc_id", "language", F.round("confidence", 4).alias("confidence"), "source")


# documents

_CONTENT = "sha256(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"


@query("content_hash_groups", f"SELECT {_CONTENT} AS content_hash, count(*) AS docs, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_hash_groups(spark, d):
    return _t(spark, d, "documents").groupBy(hashing.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"))


@query("exact_duplicates", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_CONTENT}) AS first_id, md5(text) AS raw_hash FROM documents QUALIFY first_id < doc_id")
def exact_duplicates(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("h"), hashing.raw_hash(F.col("text")).alias("raw_hash"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "h").filter("first_id < doc_id").select("doc_id", "first_id", "raw_hash")


_VOTES = " + ".join(f"CASE WHEN sum(((h >> {b}) & 1)::INT * 2 - 1) > 0 THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
_PRINTS = f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) AS s FROM w),
hs AS (SELECT doc_id, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM sh),
fu AS (SELECT doc_id, {_VOTES} AS u FROM hs GROUP BY doc_id),
fp AS (SELECT doc_id, (CASE WHEN u >= {1 << 63}::HUGEINT THEN u - {1 << 64}::HUGEINT ELSE u END)::BIGINT AS fp FROM fu)"""


@query("simhash_fingerprints", f"WITH {_PRINTS} SELECT doc_id, fp AS simhash FROM fp")
def simhash_fingerprints(spark, d):
    return spread(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", hashing.simhash("text").alias("simhash"))


@query("near_dup_pairs", f"WITH {_PRINTS}, u AS (SELECT DISTINCT fp FROM fp) SELECT a.fp AS fp_a, b.fp AS fp_b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM u a JOIN u b ON a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= 9")
def near_dup_pairs(spark, d):
    return dedup.near_pairs(spread(_t(spark, d, "documents").select("text")).select(hashing.simhash("text").alias("fp")))


_LEADERS = f"""WITH RECURSIVE {_PRINTS},
g AS MATERIALIZED (SELECT doc_id, fp, {_CONTENT} AS h, row_number() OVER (ORDER BY doc_id) AS rn FROM documents JOIN fp USING (doc_id) WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50),
r AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS doc_id, NULL::BIGINT AS same, NULL::STRUCT(d INTEGER, i BIGINT) AS best, []::STRUCT(i BIGINT, f BIGINT, h VARCHAR)[] AS kept
  UNION ALL
  SELECT x.rn, x.doc_id, x.same, x.best, CASE WHEN x.same IS NULL AND (x.best IS NULL OR x.best.d > 9) THEN list_append(x.kept, {{'i': x.doc_id, 'f': x.fp, 'h': x.h}}) ELSE x.kept END
  FROM (
    SELECT g.rn, g.doc_id, g.fp, g.h, r.kept, list_min(list_transform(list_filter(r.kept, lambda k: k.h = g.h), lambda k: k.i)) AS same,
      list_min(list_transform(r.kept, lambda k: {{'d': bit_count(xor(k.f, g.fp))::INTEGER, 'i': k.i}})) AS best
    FROM r JOIN g ON g.rn = r.rn + 1
  ) x
),
q AS (SELECT doc_id, same, best, same IS NOT NULL OR coalesce(best.d <= 9, false) AS dup FROM r WHERE doc_id IS NOT NULL),
out AS (
  SELECT doc_id AS id, dup AS is_duplicate, CASE WHEN same IS NOT NULL THEN 1.0 WHEN dup THEN 1 - best.d / 64 ELSE 0.0 END::DOUBLE AS similarity,
    CASE WHEN dup THEN coalesce(same, best.i) END AS matching_id, CASE WHEN same IS NOT NULL THEN 'exact_hash' WHEN dup THEN 'simhash' ELSE 'unique' END AS method FROM q
  UNION ALL
  SELECT doc_id, false, 0.0, NULL, 'skipped_short_content' FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50
)"""


@query("dedup_leaders", f"{_LEADERS} SELECT * FROM out")
def dedup_leaders(spark, d):
    return dedup.deduplicated(_t(spark, d, "documents"))


@query("dedup_stats", f"{_LEADERS} SELECT count(*) FILTER (method = 'unique') AS unique_documents, count(*) FILTER (is_duplicate) AS duplicates_found, 0.85::DOUBLE AS threshold FROM out")
def dedup_stats(spark, d):
    return dedup.stats(dedup_leaders(spark, d))


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}"
_PLACEHOLDERS = ", ".join(f"'{p}'" for p in entities.PLACEHOLDERS)
_VALID = f"lambda e: split_part(e, '@', -1) NOT IN ({_PLACEHOLDERS}) AND NOT regexp_matches(e, '\\.(png|jpg|gif|svg)$')"


def _emails_sql(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, '\\b({_EMAIL})\\b', 1), lambda e: lower(e)), {_VALID})"


_SHOWN = "text"
for _pattern, _sign in entities.DISGUISES:
    _SHOWN = f"regexp_replace({_SHOWN}, '{_pattern}', '{_sign}', 'gi')"


@query("entity_emails", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({_emails_sql('text')}, {_emails_sql('r')}))), ',') AS emails FROM (SELECT doc_id, text, {_SHOWN} AS r FROM documents)")
def entity_emails(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(entities.emails(F.col("text")), ",").alias("emails"))


@query("emails_deobfuscated", f"SELECT doc_id, md5({_SHOWN}) AS revealed_md5 FROM documents")
def emails_deobfuscated(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(entities.revealed(F.col("text"))).alias("revealed_md5"))


def _phones_sql() -> str:
    found = ", ".join("regexp_extract_all(text, '{}')".format(p.replace("'", "''")) for p in entities.PHONES)
    kept = f"list_transform(flatten([{found}]), lambda p: regexp_replace(trim(p), '[^0-9+() -]', '', 'g'))"
    return f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({kept}, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7))), ',') AS phones FROM documents"


@query("entity_phones", _phones_sql())
def entity_phones(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(entities.phones(F.col("text")), ",").alias("phones"))


def _records_sql() -> str:
    emails = f"array_to_string(list_sort(list_distinct(list_concat({_emails_sql('text')}, {_emails_sql('r')}))), ',')"
    return f"""{_class_sql()}, {_EDGES},
t AS (SELECT page_id AS doc_id, url, html, {_clean_sql()} AS text FROM pages), shown AS (SELECT *, {_SHOWN} AS r FROM t),
inside AS (SELECT src, string_agg(dst, ' ' ORDER BY pos) AS internal FROM edges GROUP BY src), f AS ({_phones_sql().replace("FROM documents", "FROM t")})
SELECT url, {_HOST.format("url")} AS domain, NULL::INT AS depth, {_UNESCAPE.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS title, '' AS description, text AS text_content, regexp_extract(html, '<html lang="([^"]*)"', 1) AS declared,
  lower(split_part(regexp_extract(html, '<html lang="([^"]*)"', 1), '-', 1)) AS language, 'html_attribute' AS language_source, '{{}}' AS og, coalesce(internal, '') AS internal, '' AS external, {emails} AS emails, phones, '' AS social_links, type, confidence
FROM shown JOIN c ON page_id = doc_id JOIN f USING (doc_id) LEFT JOIN inside ON src = url"""


@query("page_records", _records_sql())
def page_records(spark, d):
    """The record of every page, its groups flat (plans.pipeline.page_records has them as structs)."""
    r = pipeline.page_records(_t(spark, d, "pages"), language.profiles(_t(spark, d, "documents")))
    return r.select(
        "url", "domain", "depth", "title", "description", "text_content", F.col("metadata.language").alias("declared"), "language", F.col("language_detected.source").alias("language_source"),
        F.to_json("metadata.og").alias("og"), F.array_join("links.internal", " ").alias("internal"), F.array_join("links.external", " ").alias("external"), F.array_join("entities.emails", ",").alias("emails"),
        F.array_join("entities.phones", ",").alias("phones"), F.array_join("entities.social_links.url", " ").alias("social_links"), F.col("classification.type").alias("type"), F.col("classification.confidence").alias("confidence"),
    )


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_SCORED = f"""s0 AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 20) AS ss FROM documents),
s1 AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx FROM s0),
f0 AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents),
f1 AS (SELECT doc_id, word, count(*) AS n FROM f0 WHERE word NOT IN ({_STOP}) GROUP BY ALL),
t0 AS (SELECT doc_id, idx, sentence, unnest({_WORDS.format('sentence')}) AS word FROM s1),
t1 AS (SELECT t0.doc_id, idx, sentence, sum(coalesce(n, 0)) / count(*) AS m FROM t0 LEFT JOIN f1 ON f1.doc_id = t0.doc_id AND f1.word = t0.word GROUP BY ALL),
sc AS (SELECT s1.doc_id, s1.idx::INT AS idx, s1.sentence, round(coalesce(m, 0) * CASE WHEN s1.idx < 3 THEN 1.2 ELSE 1.0 END::DOUBLE, 6) AS score FROM s1 LEFT JOIN t1 ON t1.doc_id = s1.doc_id AND t1.idx = s1.idx)"""


@query("sentence_scores", f"WITH {_SCORED} SELECT doc_id, idx, md5(sentence) AS sentence_md5, round(score, 4) AS score FROM sc")
def sentence_scores(spark, d):
    return text.sentence_scores(_t(spark, d, "documents")).select("doc_id", "idx", F.md5("sentence").alias("sentence_md5"), F.round("score", 4).alias("score"))


@query(
    "summaries",
    f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM sc),
j AS (SELECT doc_id, max(n) AS n, string_agg(sentence, ' ' ORDER BY idx) AS joined FROM r WHERE k <= 3 GROUP BY doc_id),
b AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM documents)
SELECT doc_id, CASE WHEN length(bare) < 50 THEN 'too_short' WHEN coalesce(n, 0) <= 3 THEN 'full_text' ELSE 'extractive' END AS method, CASE WHEN length(bare) < 50 THEN bare ELSE coalesce(joined, '') END AS summary FROM b LEFT JOIN j USING (doc_id)""",
)
def summaries(spark, d):
    return text.summaries(_t(spark, d, "documents"))


@query("truncated", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE CASE WHEN strpos(substr(text, 2, 199), ' ') > 0 THEN regexp_replace(substr(text, 1, 200), '(?s)^(.+) [^ ]*$', '\\1') ELSE substr(text, 1, 200) END || '...' END AS truncated FROM documents")
def truncated(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("truncated"))


_TERMS = ", ".join(f"'{w}'" for w in SEARCH.split())


@query("text_search", f"SELECT doc_id FROM documents WHERE list_has_any({_WORDS.format('text')}, [{_TERMS}]) ORDER BY doc_id LIMIT 20")
def text_search(spark, d):
    return search.text_search(_t(spark, d, "documents"), SEARCH)


@query(
    "bm25_search",
    f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w WHERE len(ws) > 0),
t AS (SELECT doc_id, len(ws) AS len, unnest(ws) AS term FROM w), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM t WHERE term IN ({_TERMS}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
)
def bm25_search(spark, d):
    return search.ranked_search(_t(spark, d, "documents"), SEARCH, fields=(("text", 1.0),))


@query("word_frequencies", f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word")
def word_frequencies(spark, d):
    return text.word_frequencies(_t(spark, d, "documents"))


# the events as a request log


@query("domain_stats", f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY domain, success ORDER BY ts DESC, seq DESC) AS k FROM log) SELECT domain, count(*) AS request_count, count(*) FILTER (NOT success) AS error_count, round(coalesce(avg(response_time) FILTER (success AND k <= 50), 0), 3) AS avg_response_time FROM r GROUP BY domain")
def domain_stats(spark, d):
    return politeness.domain_stats(request_log(_t(spark, d, "events")))


@query(
    "rolling_avg_50",
    f"""WITH {_LOG}, g AS (SELECT domain, seq, sum(response_time::DECIMAL(28,6)) OVER (PARTITION BY domain ORDER BY ts, seq ROWS 49 PRECEDING)::DOUBLE / count(*) OVER (PARTITION BY domain ORDER BY ts, seq ROWS 49 PRECEDING) AS m FROM log WHERE success)
SELECT log.domain, log.seq, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY log.domain ORDER BY ts, log.seq ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS avg_response_time FROM log LEFT JOIN g ON g.domain = log.domain AND g.seq = log.seq""",
)
def rolling_avg_50(spark, d):
    return politeness.rolling_response_time(request_log(_t(spark, d, "events"))).select("domain", "seq", "avg_response_time")


@query("consecutive_errors", f"WITH {_RUNS} SELECT domain, seq, consecutive_errors FROM runs")
def consecutive_errors(spark, d):
    return politeness.with_error_runs(request_log(_t(spark, d, "events"))).select("domain", "seq", "consecutive_errors")


_DELAYS = f"""{_RUNS},
k AS (SELECT domain, ts, seq, CASE WHEN status = 429 THEN 3.0 WHEN status >= 500 OR consecutive_errors >= 3 THEN 2.0 WHEN consecutive_errors = 0 AND status < 400 THEN 0.95 ELSE 1.0 END::DOUBLE AS f FROM runs),
l AS (SELECT domain, list(seq ORDER BY ts, seq) AS seqs, list(ts ORDER BY ts, seq) AS tss, list(f ORDER BY ts, seq) AS fs FROM k GROUP BY domain),
dl AS (SELECT domain, unnest(seqs) AS seq, unnest(tss) AS ts, unnest(list_transform(range(1, len(fs) + 1), lambda n: list_reduce(list_prepend(1.0::DOUBLE, fs[1:n]), lambda x, f: CASE WHEN f > 1 THEN least(x * f, 10.0) WHEN f < 1 THEN greatest(x * f, 0.5) ELSE x END))) AS delay FROM l)"""


@query("adaptive_delay", f"WITH {_DELAYS} SELECT domain, seq, delay FROM dl")
def adaptive_delay(spark, d):
    return politeness.adaptive_delays(request_log(_t(spark, d, "events"))).select("domain", "seq", "delay")


@query("required_wait", f"WITH {_DELAYS} SELECT domain, seq, greatest(0.0::DOUBLE, coalesce(lag(delay) OVER w, 1.0::DOUBLE) - coalesce(epoch(ts) - epoch(lag(ts) OVER w), 1e18)) AS wait FROM dl WINDOW w AS (PARTITION BY domain ORDER BY ts, seq)")
def required_wait(spark, d):
    log = request_log(_t(spark, d, "events"))
    return politeness.required_waits(log, politeness.adaptive_delays(log)).select("domain", "seq", "wait")


_HEALTH = f"""{_RUNS}, rk AS (SELECT *, row_number() OVER (PARTITION BY domain, success ORDER BY ts DESC, seq DESC) AS k FROM runs),
health AS (SELECT domain AS proxy, count(*) FILTER (success) AS usage_count, arg_max(consecutive_errors, (ts, seq)) AS failure_count, arg_max(consecutive_errors, (ts, seq)) < 3 AS is_healthy, round(coalesce(avg(response_time) FILTER (success AND k <= 20), 0), 4) AS avg_response_time FROM rk GROUP BY domain)"""


@query("proxy_health", f"WITH {_HEALTH} SELECT * FROM health")
def proxy_health(spark, d):
    return politeness.proxy_health(request_log(_t(spark, d, "events"))).withColumn("avg_response_time", F.round("avg_response_time", 4))


@query("proxy_stats", f"WITH {_HEALTH} SELECT count(*) AS total, count(*) FILTER (is_healthy) AS healthy, count(*) FILTER (NOT is_healthy) AS unhealthy FROM health")
def proxy_stats(spark, d):
    return politeness.proxy_stats(politeness.proxy_health(request_log(_t(spark, d, "events"))))


@query("round_robin_proxy", f"WITH {_HEALTH}, pool AS (SELECT proxy, row_number() OVER (ORDER BY proxy) - 1 AS k, count(*) OVER () AS size FROM health WHERE is_healthy) SELECT event_id AS seq, proxy FROM events JOIN pool ON event_id % size = k")
def round_robin_proxy(spark, d):
    log = request_log(_t(spark, d, "events"))
    return politeness.round_robin(log, politeness.proxy_health(log))
