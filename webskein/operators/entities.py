"""Emails, phone numbers and social links, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and lists that decide what counts.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = (r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\+44\s?\d{4}\s?\d{6}", r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}")
DISGUISES = ((r"\[at\]", "@"), (r"\(at\)", "@"), (" at ", "@"), (r"\[dot\]", "."), (r"\(dot\)", "."), (" dot ", "."))
PLACEHOLDERS = ("example.com", "test.com", "email.com", "domain.com", "sample.com")
PLATFORMS = (
    ("twitter", r"twitter\.com/|x\.com/"), ("facebook", r"facebook\.com/|fb\.com/"), ("instagram", r"instagram\.com/"), ("linkedin", r"linkedin\.com/"), ("youtube", r"youtube\.com/|youtu\.be/"),
    ("github", r"github\.com/"), ("tiktok", r"tiktok\.com/"), ("pinterest", r"pinterest\.com/"), ("reddit", r"reddit\.com/"), ("mastodon", r"mastodon\.\w+/"),
)


def revealed(text: Column) -> Column:
    """The text with disguised at and dot signs replaced, in order."""
    for pattern, sign in DISGUISES:
        text = F.regexp_replace(text, f"(?i){pattern}", sign)
    return text


def valid_email(email: Column) -> Column:
    email = F.lower(email)
    return F.contains(email, F.lit("@")) & ~F.substring_index(email, "@", -1).isin(*PLACEHOLDERS) & ~email.rlike(r"\.(png|jpg|gif|svg)$") & email.rlike("^" + EMAIL)


def emails(text: Column, hrefs: Column | None = None) -> Column:
    """Sorted distinct addresses in the text as it is and revealed, and in mailto links."""
    found = F.array_union(*(F.transform(F.regexp_extract_all(t, F.lit(EMAIL), F.lit(0)), F.lower) for t in (text, revealed(text))))
    if hrefs is not None:
        mail = F.filter(hrefs, lambda h: h.startswith("mailto:"))
        found = F.array_union(found, F.transform(mail, lambda h: F.lower(F.trim(F.split_part(F.substring(h, 8, 1 << 20), F.lit("?"), F.lit(1))))))
    return F.array_sort(F.array_distinct(F.filter(found, valid_email)))


def phones(text: Column) -> Column:
    """Sorted distinct numbers of seven digits or more, of digits, +, -, brackets and spaces."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PHONES)))
    kept = F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"[^\d+\-() ]", ""))
    return F.array_sort(F.array_distinct(F.filter(kept, lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 7)))


def platform(url: Column) -> Column:
    """The first platform whose pattern is found anywhere in the URL; null if none is."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PLATFORMS):
        out = F.when(url.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def social(hrefs: Column) -> Column:
    """The distinct absolute links to a platform, by their first place."""
    absolute = F.filter(F.transform(hrefs, lambda h: F.regexp_replace(h, r"^\s+|\s+$", "")), lambda h: h.rlike("^https?://"))
    return F.array_distinct(F.filter(F.transform(absolute, lambda h: F.struct(platform(h).alias("platform"), h.alias("url"))), lambda e: e["platform"].isNotNull()))


def social_links(pages: DataFrame, hrefs: str = "hrefs") -> DataFrame:
    """url, pos, platform, link: each page's distinct absolute links to a platform; pages of one URL keep theirs apart."""
    links = pages.withColumn("page", F.monotonically_increasing_id()).select("page", "url", F.posexplode(hrefs).alias("pos", "link")).withColumn("link", F.trim("link")).filter(F.col("link").rlike("^https?://"))
    return links.withColumn("platform", platform(F.col("link"))).filter("platform is not null").groupBy("page", "url", "link").agg(F.min("pos").alias("pos"), F.min_by("platform", "pos").alias("platform")).select("url", "pos", "platform", "link")
