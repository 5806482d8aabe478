import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webskein.functions import hashing, markup, text
from webskein.operators import entities


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_hashes(spark):
    assert one(spark, hashing.content_hash(F.lit("  Hello \n WORLD "))) == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert one(spark, hashing.raw_hash(F.lit(""))) == "" and one(spark, hashing.raw_hash(F.lit("a"))) == "0cc175b9c0f1b6a831c399e269772661"


@pytest.mark.parametrize("t,want", [("", -1621285313438006658), ("hello", -5084109257958767214), ("The quick brown fox jumps over the lazy dog", -7376881687883215997)])
def test_simhash(t, want):
    assert hashing.fingerprint(t) == want


@given(st.text(max_size=80), st.text(max_size=80))
def test_distance_is_symmetric(a, b):
    x, y = hashing.fingerprint(a), hashing.fingerprint(b)
    d = bin((x ^ y) & (1 << 64) - 1).count("1")
    assert d == bin((y ^ x) & (1 << 64) - 1).count("1") and (a != b or d == 0)
    assert hashing.character_fingerprint("") == 0


def test_compared(spark):
    pages = spark.createDataFrame([("http://a/x", "some text of the page"), ("http://a/y", "some text of the page"), ("http://a/z", ""), ("http://b/", None)], "url string, text string")
    prints = hashing.fingerprints(pages)
    got = {(r.url_a, r.url_b): r for r in hashing.compared(prints.alias("a").join(prints.alias("b"), F.col("a.url") < F.col("b.url"))).collect()}
    assert got["http://a/x", "http://a/y"].is_duplicate and got["http://a/x", "http://a/y"].url_similarity == 0
    assert not got["http://a/z", "http://b/"].is_duplicate and got["http://a/z", "http://b/"].similarity == 0
    assert one(spark, hashing.is_near(F.lit(7), F.lit(0))) is False and one(spark, hashing.is_near(F.lit(7), F.lit(6)))


def test_text(spark):
    assert one(spark, text.sanitize(F.lit("a\x00b\x1f\tc\n"))) == "ab\tc\n"
    assert one(spark, text.truncate(F.lit("one two three"), 9)) == "one two..." and one(spark, text.truncate(F.lit("abcdef"), 3)) == "abc..." and one(spark, text.truncate(F.lit("abc"), 3)) == "abc"
    assert [one(spark, text.dimension(F.lit(v))) for v in ("10px", " 3.7 ", "x", "")] == [10, 3, None, None]
    rows = [(1, "short"), (2, "Only one long enough sentence here. And another that is long enough too."), (3, "The cat sat on a mat near cats. " * 2 + "A dog ran over a very long green hill. Cat cat cat cat cat cat cat. Something else that is entirely new here now."), (4, None)]
    got = {r.doc_id: r for r in text.summaries(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert (got[1].method, got[1].summary, got[2].method, got[4].method, got[4].summary) == ("too_short", "short", "full_text", "too_short", "")
    assert got[2].summary == "Only one long enough sentence here And another that is long enough too."
    assert got[3].method == "extractive" and "Cat cat cat" in got[3].summary


def test_markup(spark):
    html = "<html lang='en-US'><head><TITLE> A &amp; B </TITLE><meta charset=latin1></head><body class=x><a href='/q'>q</a></body>"
    got = [one(spark, f(F.lit(html))) for f in (markup.title, markup.lang, markup.primary_lang, markup.charset, markup.needs_javascript)]
    assert got == ["A & B", "en-US", "en", "latin1", True]
    assert one(spark, markup.keywords(F.lit("a, b,, c "))) == ["a", "b", "c"]
    reason = lambda h, s, v="": one(spark, markup.blocked_reason(F.lit(h), F.lit(s), F.lit(v)))
    assert (reason("", 403), reason("", 429), reason("", 503, "CloudFlare"), reason("x reCAPTCHA", 200), reason("ok", 503)) == ("403_forbidden", "429_rate_limited", "cloudflare_challenge", "blocked_indicator: captcha", None)
    assert one(spark, markup.blocked_reason_rendered(F.lit("<div class=g-recaptcha>"), F.lit(200))) == "recaptcha_detected"
    assert one(spark, markup.render_mode(F.lit(html), "javascript")) and not one(spark, markup.render_mode(F.lit(html), "static"))


def test_entities(spark):
    phones = one(spark, entities.phones(F.lit("Call +1-555-012-3456 or 555.123.4567 or +44 2071 234567")))
    assert phones == ["+1-555-012-3456", "+44 2071 234567", "5551234567"]
    emails = lambda t, h=(): one(spark, entities.emails(F.lit(t), F.array(*map(F.lit, h)) if h else None))
    assert emails("hein.19@mail5.example.com a@example.com") == ["hein.19@mail5.example.com"]
    assert emails("joe[at]site[dot]org and joe at site dot org") == ["joe@site.org"] and emails("joe [at] site [dot] org") == []
    assert emails("logo@2x.png", ("mailto:Me@Site.org?subject=x", "/a")) == ["me@site.org"]
    pages = spark.createDataFrame([("u", ["https://netflix.com/x", "/x.com/", "https://github.com/a", "https://netflix.com/x", "https://fb.com/p"])], "url string, hrefs array<string>")
    assert [(r.platform, r.link) for r in entities.social_links(pages).orderBy("pos").collect()] == [("twitter", "https://netflix.com/x"), ("github", "https://github.com/a"), ("facebook", "https://fb.com/p")]


def test_html_summaries(spark):
    long = "A first paragraph that is long enough to be a summary of the page."
    pages = spark.createDataFrame([("a", "text", ["short one", long + "x" * 600]), ("b", "short", []), ("c", None, None)], "url string, text string, paragraphs array<string>")
    got = {r.url: (r.method, r.summary) for r in text.html_summaries(pages).collect()}
    assert got == {"a": ("first_paragraph", (long + "x" * 600)[:500]), "b": ("too_short", "short"), "c": ("too_short", "")}


def test_config(tmp_path):
    from webskein import config

    path = tmp_path / "c.json"
    path.write_text('{"crawl": {"max_depth": 3}, "politeness": {"max_delay": 9.0}}')
    c = config.load(str(path), {"crawl": {"max_depth": 2}})
    assert (c.crawl.max_depth, c.politeness.max_delay, c.output.batch_size, c.as_dict()["extraction"]["store_html"]) == (2, 9.0, 100, False)
    for bad in ({"none": {}}, {"crawl": {"render_mode": "x"}}, {"politeness": {"min_delay": 0}}):
        with pytest.raises(ValueError):
            config.load(None, bad)


def test_references_without_semicolons(spark):
    row = spark.range(1).select(markup.unescape(F.lit("a &amp b &ltx&gt; &amp;lt; &quot &#39; &#39 &copy")).alias("x")).first()
    assert row.x == "a & b <x> &lt; \" ' &#39 ©"
