"""Page types by weighted signals, in whole tenths so that no order of addition matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals of each type: tags, classes, og types, schemas.
SIGNALS = {
    "article": ("article time byline", "article post blog story entry news editorial", "article newsarticle blogposting", "Article NewsArticle BlogPosting"),
    "product": ("", "product price add-to-cart buy shopping cart sku", "product", "Product Offer"),
    "listing": ("", "listing results grid catalog gallery directory", "", "ItemList CollectionPage"),
    "forum": ("", "forum thread reply comment discussion topic post-list", "", "DiscussionForumPosting"),
    "homepage": ("", "homepage home landing hero welcome main-page", "website", "WebSite"),
    "contact": ("address", "contact address phone email location map", "contactpage", "ContactPage"),
    "about": ("", "about bio team story mission history", "aboutpage", "AboutPage"),
    "faq": ("details summary", "faq question answer accordion help support", "faqpage", "FAQPage"),
}
TYPES = tuple(SIGNALS)


def tenths(kind: str, low: Column, low_url: Column, og_type: Column | None = None, schemas: Column | None = None) -> Column:
    """The score of one type, times ten; html and URL in lower case."""
    tags, classes, og_types, names = (x.split() for x in SIGNALS[kind])
    has = lambda c, text: F.contains(c, F.lit(text))
    parts = [F.when(low.rlike(rf"<{tag}[\s/>]"), 10).otherwise(0) for tag in tags]
    for name in classes:
        for attr in ("class", "id"):
            parts.append(F.when(has(low, f'{attr}="{name}"') | has(low, f"{attr}='{name}'"), 5).otherwise(0))
        parts.append(F.when(has(low, name), 2).otherwise(0))
        parts.append(F.when(has(low_url, name), 3).otherwise(0))
    if og_type is not None:
        parts += [F.when(F.lower(og_type) == t, 20).otherwise(0) for t in og_types]
    if schemas is not None and names:
        parts.append(20 * F.size(F.filter(schemas, lambda s: s.isin(*names))))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def classification(html: Column, url: Column, og_type: Column | None = None, schemas: Column | None = None) -> Column:
    """type, confidence, scores (by type) and up to two secondary types over 0.5, of a page; ties go by the types' order."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    # in lower case once, not for each signal
    lowered = F.array(F.struct(F.lower(html).alias("html"), F.lower(url).alias("url")))
    scores = lambda x: F.array(*(F.struct((-tenths(k, x["html"], x["url"], og_type, schemas)).alias("low"), F.lit(i).alias("place"), F.lit(k).alias("type")) for i, k in enumerate(TYPES)))
    ordered = F.array_sort(F.transform(lowered, scores)[0])

    def of(s: Column) -> Column:
        top = -s[0]["low"]
        named = F.map_from_entries(F.transform(s, lambda e: F.struct(e["type"], -e["low"] / 10)))
        second = F.transform(F.filter(F.slice(s, 2, 2), lambda e: e["low"] < -5), lambda e: F.struct(e["type"].alias("type"), (-e["low"] / 10).alias("score")))
        known = top >= 10
        return F.struct(F.when(known, s[0]["type"]).otherwise("unknown").alias("type"), F.least(top / 100, F.lit(1.0)).alias("confidence"), named.alias("scores"), F.when(known, second).alias("secondary_types"))

    return F.transform(F.array(ordered), of)[0]
