import pytest
from pyspark.sql import functions as F

from webskein.functions import urls

BASE = "https://a.example.com/x/y?z=1"
CASES = [
    ("HTTP://Example.COM:80/Path//To/./Page?utm_source=google&id=123#section", None, "http://example.com/Path/To/Page?id=123"),
    ("../up", BASE, "https://a.example.com/up"),
    ("/../a", BASE, "https://a.example.com/a"),
    ("?q=2&q=1&b", BASE, "https://a.example.com/x/y?b=&q=1&q=2"),
    ("https://h.example.com/a%2Fb%26c?x=a%26b=2", None, "https://h.example.com/a/b&c?b=2&x=a"),
    ("//cdn.example.net/i.png", BASE, "https://cdn.example.net/i.png"),
    ("http://h.example.com:8080", None, "http://h.example.com:8080/"),
    ("https://u:p@h.example.com/", None, "https://u:p@h.example.com/"),
    ("/café/ü ber", BASE, "https://a.example.com/caf%C3%A9/%C3%BC%20ber"),
    ("/a/b/../../c/", BASE, "https://a.example.com/c"),
    ("/p?REF=1&si=2&Z=3&a=*~+", BASE, "https://a.example.com/p?Z=3&a=%2A~+"),
    ("mailto:x@y.zz", BASE, None),
    ("ftp://h/x", None, None),
    ("http://h.example.com:99999/", None, None),
    (None, None, None),
    ("", None, None),
    ("http://h.example.com/a;v=1?x=1", None, "http://h.example.com/a;v=1?x=1"),
]


@pytest.mark.parametrize("url,base,want", CASES)
def test_normalized(url, base, want):
    assert urls.normalized(url, base) == want


def test_normalize_column_and_idempotence(spark):
    df = spark.createDataFrame([(u, b) for u, b, _ in CASES], "u string, b string")
    assert [r[0] for r in df.select(urls.normalize("u", "b")).collect()] == [w for _, _, w in CASES]
    for _, _, w in CASES:
        if w and "%" not in w:
            assert urls.normalized(w) == w


def test_parts(spark):
    df = spark.createDataFrame([("https://User@www.Shop.co.uk:8443/a/b.TAR.gz?x#y",), ("http://example.com",), ("http://h/x/.hidden",), ("http://h/a.pdf/",), ("not a url",)], "u string")
    u = F.col("u")
    rows = df.select(urls.netloc(u), urls.subdomain(u), urls.domain(u), urls.extension(u), urls.file_type(u), urls.is_downloadable(u), urls.is_webpage(u), urls.mime_type(u)).collect()
    assert tuple(rows[0]) == ("User@www.Shop.co.uk:8443", "www.shop.co.uk", "shop.co.uk", ".gz", "GZ", True, False, "application/octet-stream")
    assert tuple(rows[1])[:5] == ("example.com", "example.com", "example.com", "", "Unknown")
    assert rows[2][3] == "" and rows[3][3:5] == (".pdf", "PDF Document") and rows[3][7] == "application/pdf"
    one = spark.range(1)
    text = lambda c: one.select(c).first()[0]
    assert text(urls.url_hash(F.lit("HTTP://Example.com/a "))) == "3e27a17e84f5f8486fbc14488e12e6ff"
    assert text(urls.is_image(F.lit("/a.PNG"))) and text(urls.is_video(F.lit("/a.mp4"))) and not text(urls.is_video(F.lit("/a")))
    assert text(urls.is_internal(F.lit("http://a.example.com/"), F.lit("http://b.example.com/"))) and not text(urls.is_internal(F.lit("http://a.example.com/"), F.lit("http://b.example.com/"), False))


@pytest.mark.parametrize("a,b,want", [("", "http://a/", 0), ("http://a/x", "http://a/x", 1), ("http://a/x", "http://b/x", 0), ("http://a/", "http://a", 1), ("http://a/x/y", "http://a/x/z", 0.5), ("http://a/x", "http://a/x/z/w", 1 / 3)])
def test_similarity(spark, a, b, want):
    assert spark.range(1).select(urls.similarity(F.lit(a), F.lit(b))).first()[0] == pytest.approx(want)


def test_make_absolute(spark):
    df = spark.createDataFrame([("/x", BASE), ("http://q/", BASE), (None, BASE)], "u string, b string")
    assert [r[0] for r in df.select(urls.make_absolute("u", "b")).collect()] == ["https://a.example.com/x", "http://q/", None]
