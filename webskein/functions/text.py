"""Text functions: sanitising, truncation, dimensions, sentences and extractive summaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import sliced, spread

# Words that don't count for a summary.
STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would should could "
    "may might must can this that these those i you he she it we they"
).split()
WORD = r"[\p{L}\p{N}_]+"
#: The same and the sentences' ends for Python, whose \s has four control characters more than Unicode's white space.
_WORD = re.compile(r"\w+")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SENTENCE_END = re.compile(f"[.!?]+[{_SPACES}]+")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize(html: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(html, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def truncate(text: Column, most: int = 200) -> Column:
    """At most `most` characters, cut at the last space before, with dots."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(head, r"(?s)^(.+) [^ ]*$", "$1"), F.lit("...")))


def dimension(value: Column) -> Column:
    """A width or height attribute as a whole number; null where it isn't one."""
    return F.trim(F.replace(value, F.lit("px"), F.lit(""))).try_cast("double").try_cast("int")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences of over 20 characters."""
    return F.filter(F.transform(F.split(text, r"[.!?]+(?U:\s)+"), strip), lambda s: F.length(s) > 20)


def _rated(text: str) -> Iterator[tuple[str, int, int]]:
    """The sentences of a text, each with the sum of its words' counts in the whole text, and the number of its words."""
    count = Counter(_WORD.findall(text.lower()))
    for w in STOPWORDS:
        count.pop(w, None)
    for s in _SENTENCE_END.split(text):
        s = s.strip(_SPACES)
        if len(s) > 20:
            own = _WORD.findall(s.lower())
            yield s, sum(count.get(w, 0) for w in own), len(own)


def rated(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The kept columns of every row and `rated`, its text's sentences with their scores: the mean count, in the whole text, of the sentence's words; the first three count 1.2 times.

    Texts are read one by one, so nothing is shuffled.
    """
    kind = pa.struct([("sentence", pa.string()), ("total", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_text"):
            found = [list(_rated(t)) if t else [] for t in b.column("_text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = [x for f in found for x in f]
            parts = [pa.array([x[k] for x in flat], f.type) for k, f in enumerate(kind)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(kind)))], [*keep, "_rated"])

    base = spread(docs.select(*keep, F.col(text).alias("_text")))
    fields = [T.StructField(n, t) for n, t in (("sentence", T.StringType()), ("total", T.LongType()), ("words", T.LongType()))]
    read = base.mapInArrow(run, T.StructType([*(base.schema[n] for n in keep), T.StructField("_rated", T.ArrayType(T.StructType(fields)))]))
    mean = lambda s: F.when(s["words"] > 0, s["total"] / s["words"]).otherwise(0.0)
    scored = F.transform("_rated", lambda s, i: F.struct(i.alias("idx"), s["sentence"].alias("sentence"), F.round(mean(s) * F.when(i < 3, 1.2).otherwise(1.0), 6).alias("score")))
    return read.select(*keep, scored.alias("rated"))


def sentence_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, idx, sentence and score of the sentences of every row."""
    return rated(docs, (key,), text).select(key, F.explode("rated").alias("r")).select(key, "r.idx", "r.sentence", "r.score")


def _summarised(docs: DataFrame, keep: tuple[str, ...], text: str, most: int) -> DataFrame:
    """The kept columns of every row, method and summary."""
    bare = strip(F.coalesce(F.col(text), F.lit("")))
    given = docs.select(*keep, F.when(F.length(bare) < 50, bare).alias("_short"), F.col(text).alias("_text"))
    best = F.slice(F.array_sort(F.transform("rated", lambda s: F.struct((-s["score"]).alias("low"), s["idx"].alias("idx"), s["sentence"].alias("sentence")))), 1, most)
    in_order = F.array_sort(F.transform(best, lambda s: F.struct(s["idx"].alias("idx"), s["sentence"].alias("sentence"))))
    short = F.col("_short").isNotNull()
    return rated(given, (*keep, "_short"), "_text").select(
        *keep,
        F.when(short, "too_short").when(F.size("rated") <= most, "full_text").otherwise("extractive").alias("method"),
        F.when(short, F.col("_short")).otherwise(F.array_join(F.transform(in_order, lambda s: s["sentence"]), " ")).alias("summary"),
    )


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """key, method and summary of every row: the best `most` sentences in their order; all of them, or the text, where it is short."""
    return _summarised(docs, (key,), text, most)


def html_summaries(pages: DataFrame, key: str = "url", text: str = "text", paragraphs: str = "paragraphs") -> DataFrame:
    """key, method and summary of every row: the first paragraph of over 50 characters, cut at 500; without one, the summary of the text."""
    first = F.get(F.filter(F.col(paragraphs), lambda p: F.length(p) > 50), F.lit(0))
    given = pages.select(key, F.substring(first, 1, 500).alias("_first"), F.col(text).alias("_whole")).select(key, "_first", F.when(F.col("_first").isNull(), F.col("_whole")).alias("_whole"))
    return _summarised(given, (key, "_first"), "_whole", 3).select(key, F.when(F.col("_first").isNotNull(), "first_paragraph").otherwise(F.col("method")).alias("method"), F.coalesce("_first", "summary").alias("summary"))


def word_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
