"""Whole plans: page records from raw pages, and a crawl over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..operators import classify, dom, entities, frontier, language, robots
from ..session import checkpointed
from ..sources import fetching

_FIELDS = ("title", "description", "text", "canonical_url", "language", "author", "keywords", "og", "twitter", "links", "hrefs")


def page_records(pages: DataFrame, known: DataFrame | None = None, *, store_html: bool = False) -> DataFrame:
    """The page record of every page: one parse of the HTML, then expressions; the records are checkpointed before languages are detected.

    language_detected is the declared language (the html element's, else the meta element's), else that of the cleaned
    text by the profiles in known (operators.language.profiles); without profiles it is unknown. language is its
    language. depth is the pages' column of that name, null where there is none.
    """
    depth = "depth" in pages.columns
    joined = dom.extracted(pages, fields=_FIELDS, keep_html=True, keep=("depth",) if depth else ())
    urls_of = lambda inside: F.transform(F.filter("links", lambda k: k["is_internal"] == F.lit(inside)), lambda k: k["url"])
    records = joined.select(
        F.monotonically_increasing_id().alias("row"),
        F.lower(F.split(F.trim("language"), "-")[0]).alias("declared"),
        "url",
        urls.netloc(F.col("url")).alias("domain"),
        (F.col("depth") if depth else F.lit(None)).cast("int").alias("depth"),
        "title",
        "description",
        F.col("text").alias("text_content"),
        (F.col("html") if store_html else F.lit("")).alias("html"),
        F.struct("canonical_url", "language", "author", "keywords", "og", "twitter").alias("metadata"),
        F.struct(urls_of(True).alias("internal"), urls_of(False).alias("external")).alias("links"),
        F.struct(entities.emails(F.col("text"), F.col("hrefs")).alias("emails"), entities.phones(F.col("text")).alias("phones"), entities.social(F.col("hrefs")).alias("social_links")).alias("entities"),
        classify.classification(F.col("html"), F.col("url"), F.col("og")["type"]).alias("classification"),
    )
    records = checkpointed(records)  # fixes the row numbers, and pages are parsed once for both sides of the join
    known = pages.sparkSession.createDataFrame([], "lang string, gram string, p double") if known is None else known
    open_ = records.filter("declared = ''").select("row", F.col("text_content").alias("text"))
    read = language.detected(open_, known, key="row").select("row", F.struct("language", "confidence", "alternatives", "source").alias("read"))
    none = F.array().cast("array<struct<language:string,confidence:double>>")
    declared = F.struct(F.col("declared").alias("language"), F.lit(1.0).alias("confidence"), none.alias("alternatives"), F.lit("html_attribute").alias("source"))
    found = records.join(read, "row", "left").withColumn("language_detected", F.when(F.col("declared") != "", declared).otherwise(F.col("read")))
    return found.withColumn("language", F.col("language_detected")["language"]).drop("row", "declared", "read")


def crawl(start: DataFrame, corpus: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """Frontier entries reached over the corpus: each wave is checked against robots rules and fetched, and its links are the next wave's candidates."""

    def edges(wave: DataFrame) -> DataFrame:
        allowed = robots.decisions(wave, rules).filter("allowed")
        got = fetching.fetched(allowed, corpus).filter("success")
        return markup.link_edges(got.select("url", "html"))

    return frontier.crawl(start, edges, **options)
