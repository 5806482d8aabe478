"""Point look-ups and full-text search over a table of pages or documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts

# Weights of fields in ranked search, and the usual constants of BM25.
FIELDS = (("title", 3.0), ("description", 2.0), ("text_content", 1.0))
K1, B = 1.2, 0.75


def page_exists(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted URLs that the table has."""
    return wanted.select("url").join(pages.select("url"), "url", "left_semi")


def get_page(pages: DataFrame, url: str) -> DataFrame:
    return pages.filter(F.col("url") == url).limit(1)


def pages_by_domain(pages: DataFrame, domain: str, limit: int = 100) -> DataFrame:
    return pages.filter(F.col("domain") == domain).orderBy("url").limit(limit)


def count_pages(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"))


def facets(pages: DataFrame, *columns: str) -> DataFrame:
    return pages.groupBy(*columns).agg(F.count("*").alias("n"))


def _terms(query: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"\w+", query.lower())))


def text_search(docs: DataFrame, query: str, *, key: str = "doc_id", fields: tuple[str, ...] = ("text",), limit: int = 20) -> DataFrame:
    """Keys of documents with any word of the query in a field, in order of key."""
    terms = _terms(query)
    any_of = F.lit(False)
    for f in fields:
        any_of = any_of | F.arrays_overlap(texts.words(F.coalesce(F.col(f), F.lit(""))), F.array(*map(F.lit, terms)))
    return docs.filter(any_of).select(key).orderBy(key).limit(limit)


def index(docs: DataFrame, *, key: str = "doc_id", field: str = "text") -> DataFrame:
    """Inverted index of a field: term, key, tf and the field's length in words."""
    words = docs.select(F.col(key).alias("key"), texts.words(F.coalesce(F.col(field), F.lit(""))).alias("words"))
    each = words.select("key", F.size("words").alias("len"), F.explode("words").alias("term"))
    return each.groupBy("term", "key", "len").agg(F.count("*").alias("tf"))


def ranked_search(docs: DataFrame, query: str, *, key: str = "doc_id", fields: tuple[tuple[str, float], ...] = FIELDS, limit: int = 20) -> DataFrame:
    """The best documents by BM25: the best field's score times its weight; ties by key.

    One pass counts lengths and the query's few terms (a single row comes back); the other scores each row by itself, so
    nothing is shuffled but the best rows.
    """
    terms = _terms(query)
    read = docs.select(F.col(key).alias("key"), *(texts.words(F.coalesce(F.col(f), F.lit(""))).alias(f) for f, _ in fields))
    brief = read.select("key", *(F.transform(F.array(F.col(f)), lambda w: F.struct(F.size(w).alias("len"), F.filter(w, lambda x: x.isin(*terms)).alias("hits")))[0].alias(f) for f, _ in fields))
    long = lambda f: F.when(F.col(f)["len"] > 0, F.col(f)["len"])
    counts = brief.agg(*(c for i, (f, _) in enumerate(fields) for c in (F.count(long(f)).alias(f"n{i}"), F.avg(long(f)).alias(f"mean{i}"), *(F.count_if(F.array_contains(F.col(f)["hits"], t)).alias(f"df{i}_{k}") for k, t in enumerate(terms))))).first()

    def times(field: str, term: str) -> Column:
        return F.size(F.filter(F.col(field)["hits"], lambda h: h == term))

    def score(i: int, field: str) -> Column:
        out = F.lit(0.0)
        for k, term in enumerate(terms):
            df = counts[f"df{i}_{k}"]
            if df:
                idf = math.log(1 + (counts[f"n{i}"] - df + 0.5) / (df + 0.5))
                tf = times(field, term)
                out = out + F.lit(idf * (K1 + 1)) * tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B / counts[f"mean{i}"]) * F.col(field)["len"]))
        return out

    scored = brief.select("key", *(F.col(f) for f, _ in fields), F.lit(0.0).alias("none")).select("key", F.greatest("none", *(score(i, f) * weight for i, (f, weight) in enumerate(fields))).alias("score"))
    return scored.filter("score > 0").select(F.col("key").alias(key), F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)
