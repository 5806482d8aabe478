"""Language of pages: the declared one, else the nearest profile of character n-grams, learnt from labelled texts.

N-grams are counted in Arrow batches, text by text, so no row of an n-gram leaves its task but the counts of the profiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup
from ..session import sliced, spread

LEAST_CHARS = 20
#: N-grams that a language's profile keeps.
PROFILE = 300
#: Bits of a character in the number of an n-gram, which has three.
BITS = 21
#: Bytes of texts that are read at once; their n-grams take many times that.
AT_ONCE = 1 << 19


def letters(text: Column) -> Column:
    """The text's letters in lower case, words apart by one space, with one before and one after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of three characters of the texts, as numbers, and the place of each one's text."""
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(c) < 3:
        return c[:0], of[:0]
    inside = np.flatnonzero(of[:-2] == of[2:])
    return (c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])[inside], of[inside]


def _spelt(values: np.ndarray) -> np.ndarray:
    """The n-grams of numbers, as strings."""
    low = (1 << BITS) - 1
    return np.stack([values >> 2 * BITS, values >> BITS & low, values & low], axis=1).astype("<u4").view("<U3").ravel()


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, p: the most frequent n-grams of each language with their smoothed share; at most PROFILE rows a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", AT_ONCE):
            given = b.column("lang").to_pylist()
            names = {n: k for k, n in enumerate(dict.fromkeys(given))}
            values, of = grams(b.column("text").to_pylist())
            kind = np.array([names[n] for n in given])[of]
            for name, k in names.items():
                distinct, n = np.unique(values[kind == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(_spelt(distinct), pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    counted = spread(labelled).select("lang", letters(F.col("text")).alias("text")).mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("lang")
    ranked = counted.select("lang", "gram", "n", F.sum("n").over(own).alias("total"), F.row_number().over(own.orderBy(F.desc("n"), "gram")).alias("rank"))
    return ranked.filter(F.col("rank") <= PROFILE).select("lang", "gram", (F.col("n") / F.col("total")).alias("p"))


class Profiles:
    """Shares of texts' languages by the rows (lang, gram, p) of profiles."""

    def __init__(self, rows: list[tuple[str, str, float]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        rows = sorted((grams([gram])[0][0], self.langs.index(lang), np.log(p * 10_000)) for lang, gram, p in rows)
        names = np.array([r[0] for r in rows], dtype=np.int64)
        self.lang, self.weight = np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.float64)
        self.names, self.first, self.count = np.unique(names, return_index=True, return_counts=True)

    def shares(self, texts: list[str]) -> list[list[dict] | None]:
        """Per text the languages that it has n-grams of with their shares; None where there is none."""
        size = len(self.langs)
        values, of = grams(texts)
        if not len(self.names) or not len(values):
            return [None] * len(texts)
        at = np.minimum(np.searchsorted(self.names, values), len(self.names) - 1)
        hit = self.names[at] == values
        at, of = at[hit], of[hit]
        times = self.count[at]
        entry = np.arange(int(times.sum())) + np.repeat(self.first[at] - np.cumsum(times) + times, times)
        cell = np.repeat(of, times) * size + self.lang[entry]
        score = np.bincount(cell, weights=self.weight[entry], minlength=len(texts) * size).reshape(-1, size)
        seen = np.bincount(cell, minlength=len(texts) * size).reshape(-1, size) > 0
        any_ = seen.any(axis=1)
        score = np.where(seen, score, -np.inf)
        w = np.exp((score - np.where(any_, score.max(axis=1), 0.0)[:, None]) / 20)
        share = w / np.where(any_, w.sum(axis=1), 1.0)[:, None]
        return [[{"language": self.langs[k], "share": float(s[k])} for k in np.flatnonzero(x)] if x.any() else None for x, s in zip(seen, share, strict=True)]


def with_language(docs: DataFrame, known: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The kept columns of every row with language, confidence, alternatives, languages and source; texts of fewer than LEAST_CHARS characters are unknown.

    known has PROFILE rows a language at most, so it comes to the driver.
    """
    profile = Profiles([(r.lang, r.gram, r.p) for r in known.select("lang", "gram", "p").collect()])
    long = F.length(F.trim("_text")) >= LEAST_CHARS
    base = spread(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))).select(*keep, long.alias("_long"), F.when(long, letters(F.col("_text"))).otherwise("").alias("_text"))
    names = [*keep, "_long"]
    found = T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("share", T.DoubleType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("language", pa.string()), ("share", pa.float64())]))
        for b in sliced(batches, "_text", AT_ONCE):
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(profile.shares(b.column("_text").to_pylist()), kind)], [*names, "_all"])

    read = base.mapInArrow(run, T.StructType([*(base.schema[n] for n in names), T.StructField("_all", found)]))
    ranked = F.array_sort(F.transform("_all", lambda e: F.struct((-F.round(e["share"], 6)).alias("low"), e["language"].alias("language"))))
    one = lambda e: F.struct(e["language"].alias("language"), (-e["low"]).alias("confidence"))
    none = F.array().cast("array<struct<language:string,confidence:double>>")
    return read.withColumn("_all", ranked).select(
        *keep,
        F.coalesce(F.col("_all")[0]["language"], F.lit("unknown")).alias("language"),
        F.coalesce(-F.col("_all")[0]["low"], F.lit(0.0)).alias("confidence"),
        F.coalesce(F.transform(F.slice("_all", 2, 2), one), none).alias("alternatives"),
        F.coalesce(F.transform(F.filter("_all", lambda e: e["low"] < -0.1), one), none).alias("languages"),
        F.when(F.col("_all").isNotNull(), "profile").when(F.col("_long"), "detection_failed").otherwise("insufficient_content").alias("source"),
    )


def detected(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, language, confidence, alternatives, languages and source of every row."""
    return with_language(docs, known, (key,), text)


def page_languages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """url, language, confidence and source of every page: the declared language, else that of the cleaned text. Pages of one URL have each their own."""
    html = F.coalesce(F.col("html"), F.lit(""))
    declared = markup.primary_lang(html)
    read = with_language(pages.select("url", declared.alias("declared"), F.when(declared == "", markup.clean_text(html)).alias("text")), known, ("url", "declared"))
    has = F.col("declared") != ""
    return read.select("url", F.when(has, F.col("declared")).otherwise(F.col("language")).alias("language"), F.when(has, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(has, "html_attribute").otherwise(F.col("source")).alias("source"))
