import json

from pyspark.sql import functions as F

from webskein.operators import classify, dom, language
from webskein.plans import pipeline

PAGE = """<html lang="en-GB"><head><title>T</title><meta name="Description" content=" d "><meta name="keywords" content="a, ,b"><meta property="og:title" content="o"><meta property="og:title" content="o2">
<meta name="twitter:card" content="c"><meta name="theme" content="t"><link rel="canonical" href="/c"><link rel="shortcut icon" href="/f.ico">
<script type="application/ld+json">[{"@type": "Article", "n": 1}, {"x": 2}]</script><script type="application/ld+json">bad</script></head>
<body><nav><a href="/n">nav</a></nav><p>First paragraph with enough text in it, and a comma.<p>Second <b>one</b>, short.<ul><li>x<li>y</ul>
<a href="/doc.pdf" rel="nofollow me">file</a><a href="http://other.org/">out</a><a href="#f">f</a><a href="mailto:a@b.org">m</a><a href="/n#z">again</a>
<img src="/a.png"><img src="/a.png" data-srcset="/b.png 2x" alt=" A " width="10px"><picture><source srcset="/p.webp 1x, /q.webp 2x"></picture><div style="background-image:url('/bg.jpg')"></div>
<video poster="/p.jpg"><source src="/v.mp4"></video><iframe src="https://www.youtube.com/embed/1" title="yt"></iframe><iframe src="/x"></iframe><embed src="/m.webm">
<address>12 Long Street, Town</address><div class="my-address">99 Other Street, City</div>
<div itemscope itemtype="http://schema.org/Product"><span itemprop="name">N</span><meta itemprop="sku" content="S"><a itemprop="url" href="/u">z</a></div><div typeof="Person"><i property="name">P</i></div>
<footer>foot</footer></body></html>"""


def test_parts():
    p = dom.page_parts(PAGE, "http://h.example.com/d/")
    assert (p["title"], p["description"], p["keywords"], p["language"], p["charset"], p["canonical_url"], p["favicon"]) == ("T", "d", ["a", "b"], "en-GB", "utf-8", "/c", "/f.ico")
    assert (p["og"], p["twitter"], p["other_meta"]) == ({"title": "o2"}, {"card": "c"}, {"theme": "t"})
    assert [(k["url"], k["is_internal"]) for k in p["links"]] == [("http://h.example.com/n", True), ("http://h.example.com/doc.pdf", True), ("http://other.org/", False), ("http://h.example.com/u", True)]
    assert p["links"][1]["is_nofollow"] and p["links"][1]["rel"] == ["nofollow", "me"]
    assert [i["url"] for i in p["images"]] == ["http://h.example.com/a.png", "http://h.example.com/p.webp", "http://h.example.com/bg.jpg"]
    assert (p["images"][0]["alt"], p["images"][0]["width"], p["images"][0]["format"]) == ("A", 10, "PNG")
    assert len(dom.images(dom.parse('<img src="/a.png">'), "", True)) == 0 and dom.images(dom.parse('<img src="/a.png">'), "", False)[0]["url"] == "/a.png"
    assert [(v["type"], v["source"]) for v in p["videos"]] == [("html5", "self-hosted"), ("iframe", "youtube"), ("embed", "self-hosted")]
    assert [(f["filename"], f["file_type"]) for f in p["files"]] == [("doc.pdf", "PDF Document")]
    assert [(s["format"], s["type"]) for s in p["structured"]] == [("json-ld", "Article"), ("json-ld", "Unknown"), ("microdata", "Product"), ("rdfa", "Person")]
    assert json.loads(p["structured"][2]["data"]) == {"@type": "http://schema.org/Product", "name": "N", "sku": "S", "url": "/u"}
    assert p["addresses"] == ["12 Long Street, Town", "99 Other Street, City"]
    assert p["paragraphs"] == ["First paragraph with enough text in it, and a comma."]
    assert "nav" not in p["text"] and "foot" not in p["text"] and p["text"].startswith("T First paragraph") and "nav" in p["plain_text"]
    assert "First paragraph" in p["main_content"] and "class=" not in p["cleaned_html"]
    assert "nav" not in dom.without_boilerplate(PAGE)


def test_trees():
    assert [n.text() for n in dom.parse("<p>a<p>b<div>c<p>d</div>e").find("p")] == ["a", "b", "d"]
    assert [len(n.find("li")) for n in dom.parse("<ul><li>a<ul><li>b</ul><li>c</ul>").find("ul")] == [3, 1]
    assert dom.parse("</p></div>x").text() == "x" and dom.page_parts("", "")["title"] == ""
    assert dom.title(dom.parse("<h1>a <b>b</b></h1>")) == "ab"


def test_page_records(spark):
    pages = spark.createDataFrame([("http://h.example.com/d/", PAGE), ("http://e/", ""), ("http://n/", None)], "url string, html string")
    rows = {r.url: r for r in pipeline.page_records(pages).collect()}
    r = rows["http://h.example.com/d/"]
    assert (r.domain, r.title, r.html, r.language) == ("h.example.com", "T", "", "en")
    assert len(r.links.internal) == 3 and r.links.external == ["http://other.org/"] and r.entities.emails == ["a@b.org"]
    assert rows["http://e/"].text_content == "" and rows["http://n/"].classification.type == "unknown"


def test_page_records_are_whole(spark):
    text = {"en": "the cat and the dog are in the house with the other one ", "de": "der Hund und die Katze sind in dem Haus mit der anderen "}
    docs = spark.createDataFrame([(i, t * 5, k) for i, (k, t) in enumerate(text.items())], "doc_id int, text string, lang string")
    link = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    given = [
        ("http://a/", f"<html lang='fr-FR'>{text['de']}{link('https://github.com/a', ' https://X.com/b ', '/github.com/c', 'https://github.com/a', 'https://other.org/')}", 2),
        ("http://b/", f"<html><p>{text['de']}", 0), ("http://b/", f"<html><p>{text['en']}", 1), (None, "<p>short", None),
        ("http://c/", f"<meta http-equiv='content-language' content='es-ES'>{text['en']}", 0),
    ]
    pages = spark.createDataFrame(given, "url string, html string, depth int")
    rows = {(r.url, r.depth): r for r in pipeline.page_records(pages, language.profiles(docs)).collect()}
    assert len(rows) == 5
    assert [(e.platform, e.url) for e in rows["http://a/", 2].entities.social_links] == [("github", "https://github.com/a"), ("twitter", "https://X.com/b")]
    found = {k: (r.language, r.language_detected.language, r.language_detected.source) for k, r in rows.items()}
    assert found["http://a/", 2] == ("fr", "fr", "html_attribute") and found["http://c/", 0] == ("es", "es", "html_attribute")
    assert found["http://b/", 0] == ("de", "de", "profile") and found["http://b/", 1] == ("en", "en", "profile")
    assert found[None, None] == ("unknown", "unknown", "insufficient_content")
    assert rows["http://b/", 0].language_detected.confidence > 0.5 and [a.language for a in rows["http://b/", 0].language_detected.alternatives] == ["en"]
    assert rows["http://a/", 2].language_detected.alternatives == [] and pipeline.page_records(pages.drop("depth")).filter("depth is null").count() == 5


def test_sql_functions(spark):
    dom.register(spark)
    spark.createDataFrame([("http://h.example.com/", PAGE)], "url string, html string").createOrReplaceTempView("one_page")
    assert spark.sql("SELECT l.url FROM one_page, LATERAL extract_links(html, one_page.url) l WHERE l.pos = 0").first()[0] == "http://h.example.com/n"
    assert "foot" not in spark.sql("SELECT clean_html(html) FROM one_page").first()[0]


def test_classification(spark):
    html = '<html><body><article class="post">x</article></body></html>'
    c = spark.range(1).select(classify.classification(F.lit(html), F.lit(""))).first()[0]
    assert (c.type, c.confidence, c.scores["article"], c.secondary_types) == ("article", 0.19, 1.9, [])
    c = spark.range(1).select(classify.classification(F.lit("<p>"), F.lit("http://x/faq/help"), F.lit("Product"), F.array(F.lit("FAQPage")))).first()[0]
    assert c.type == "faq" and c.confidence == 0.26 and [s.type for s in c.secondary_types] == ["product"]
