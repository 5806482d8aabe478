"""Expressions over raw HTML: what needs no tree. The tree's functions are in operators.dom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import urls

# Signs of a blocked page, in order, and the reasons given.
BLOCKED = ("captcha", "recaptcha", "challenge", "access denied", "blocked", "bot detected", "please verify", "security check")
BLOCKED_RENDERED = (
    ("recaptcha", "recaptcha_detected"), ("g-recaptcha", "recaptcha_detected"), ("captcha-container", "captcha_detected"), ("cf-challenge", "cloudflare_challenge"),
    ("challenge-platform", "challenge_detected"), ("access denied", "access_denied"), ("bot detected", "bot_detected"),
)
SKIPPED_SCHEMES = ("javascript", "mailto", "tel", "data", "ftp", "file", "blob", "sms")
#: Character references by pattern: the named ones count without their semicolon too, as HTML has it.
_ENTITIES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "'"), ("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", "\xa0"), ("&amp;?", "&"))


def unescape(text: Column) -> Column:
    """The common character references, decoded."""
    for name, char in _ENTITIES:
        text = F.regexp_replace(text, name, char)
    return text


def title(html: Column) -> Column:
    return unescape(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)))


def lang(html: Column) -> Column:
    """The html element's lang, as written."""
    return F.trim(F.regexp_extract(html, r"""(?is)<html[^>]*?\slang\s*=\s*["']?([^"'\s>]*)""", 1))


def primary_lang(html: Column) -> Column:
    return F.lower(F.split(lang(html), "-")[0])


def charset(html: Column) -> Column:
    found = F.regexp_extract(html, r"""(?is)<meta[^>]*?\scharset\s*=\s*["']?([^"'\s>]+)""", 1)
    declared = F.regexp_extract(html, r"""(?is)<meta[^>]*?http-equiv\s*=\s*["']?Content-Type["']?[^>]*?charset=([^"'\s>]+)""", 1)
    return F.when(found != "", found).when(declared != "", declared).otherwise("utf-8")


def keywords(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, ","), lambda k: F.trim(k)), lambda k: k != "")


def clean_text(html: Column) -> Column:
    """Text without scripts, boilerplate elements and tags, single-spaced; the title stays."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style|noscript|iframe|embed|object|applet|canvas|svg|nav|header|footer|aside)\b[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"""(?is)<div\b[^>]*\sclass\s*=\s*["']?(?:ad|advertisement|nav|navigation|menu|sidebar|header|footer|social|share|related|comments)["'\s>][^<]*</div>""", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"<[^>]*>", " ")), r"(?U)\s+", " "))


def needs_javascript(html: Column) -> Column:
    return (F.length(html) < 1000) | ~F.contains(html, F.lit("<a"))


def render_mode(html: Column, mode: str = "auto") -> Column:
    return {"javascript": F.lit(True), "static": F.lit(False)}.get(mode, needs_javascript(html))


def _first(conditions: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, reason in reversed(conditions):
        out = F.when(condition, F.lit(reason)).otherwise(out)
    return out


def blocked_reason(html: Column, status: Column, server: Column) -> Column:
    """Why a fetched page counts as blocked; null if it doesn't."""
    head = F.lower(F.substring(html, 1, 5000))
    early = [(status == 403, "403_forbidden"), (status == 429, "429_rate_limited"), ((status == 503) & F.contains(F.lower(server), F.lit("cloudflare")), "cloudflare_challenge")]
    return _first([*early, *((F.contains(head, F.lit(sign)), f"blocked_indicator: {sign}") for sign in BLOCKED)])


def blocked_reason_rendered(html: Column, status: Column) -> Column:
    head = F.lower(F.substring(html, 1, 10000))
    return _first([(status == 403, "403_forbidden"), (status == 429, "429_rate_limited"), *((F.contains(head, F.lit(sign)), reason) for sign, reason in BLOCKED_RENDERED)])


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'>\s]+)"""), F.lit(1)), lambda h: F.trim(h))


def link_edges(pages: DataFrame) -> DataFrame:
    """src, pos, dst, is_internal: each page's distinct links, normalised, by their first place."""
    raw = pages.select(F.col("url").alias("src"), F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    scheme = F.lower(F.regexp_extract("href", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    kept = raw.filter((F.col("href") != "") & ~F.col("href").startswith("#") & ~scheme.isin(*SKIPPED_SCHEMES))
    resolved = kept.withColumn("dst", urls.normalize(F.col("href"), F.col("src"))).filter("dst is not null")
    first = resolved.withColumn("place", F.row_number().over(Window.partitionBy("src", "dst").orderBy("pos"))).filter("place = 1")
    return first.select("src", "pos", "dst", urls.is_internal(F.col("dst"), F.col("src")).alias("is_internal"))
