"""What a task holds at once, and what leaves it, at any number of rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webskein.functions import text
from webskein.operators import dedup, dom, language
from webskein.session import sliced

PAGE = "<html><body><nav>n</nav><article><p>" + "a b, c. " * 200 + "</p></article></body></html>"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single)", planned(df)))


def test_slices_are_bounded_and_whole():
    b = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 50, "", "z" * 3] * 100, "id": list(range(500))})
    parts = list(sliced(iter([b]), "text", 60))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(500))
    assert max(sum(map(len, filter(None, p.column("text").to_pylist()))) for p in parts) <= 60


def test_a_batch_of_pages_is_read_in_slices(spark, monkeypatch):
    """The trees of all pages of a batch would be held at once, and one batch come out."""
    pages = spark.createDataFrame([(1, "https://a.example.com/", PAGE)], "page_id long, url string, html string")
    runs = []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, f, schema: runs.append(f))
    dom.extracted(pages, fields=("text",), keep=("page_id",))
    b = pa.RecordBatch.from_pydict({"url": [None] * 3000, "html": [PAGE] * 3000, "page_id": list(range(3000))})
    out = list(runs[0](iter([b])))
    assert [i for x in out for i in x.column("page_id").to_pylist()] == list(range(3000))
    assert len(out) > 1 and max(x.num_rows for x in out) * len(PAGE) <= dom.AT_ONCE


def test_only_the_named_parts_of_a_page_are_made():
    whole = dom.page_parts(PAGE, "https://a.example.com/")
    assert set(whole) >= set(dom._FIELDS)
    for name in dom._FIELDS:
        some = dom.page_parts(PAGE, "https://a.example.com/", fields=(name,))
        assert some[name] == whole[name] and len(some) < len(whole)


@pytest.mark.parametrize("query", [text.sentence_scores, text.summaries, lambda d: text.html_summaries(d.withColumn("paragraphs", F.split("text", "\n")), key="doc_id")])
def test_sentences_are_rated_without_a_shuffle(spark, query):
    docs = spark.range(0, 40, 1, 8).select((F.col("id") * 7 % 41).alias("doc_id"), F.lit("One two three four five six. " * 4 + "The end of all the words that were said!").alias("text"))
    found = query(docs)  # the ids aren't those of the range, which is dealt out by them already
    assert exchanges(found) == 0
    assert found.select("doc_id").distinct().count() == 40


def test_languages_are_read_without_a_shuffle(spark):
    docs = spark.range(0, 40, 1, 8).select(F.col("id").alias("doc_id"), F.lit("the quick brown fox runs over the hill").alias("text"), F.lit("en").alias("lang"))
    found = language.detected(docs, language.profiles(docs))
    assert exchanges(found) == 0
    assert found.filter("language = 'en' and confidence = 1.0").count() == 40


def test_near_pairs_broadcast_no_keys(spark):
    """By the plan's guess the table of keys is small, so it came to the driver to be broadcast."""
    prints = spark.range(0, 3000, 1, 8).select(F.xxhash64("id").alias("fp"))
    found = dedup.near_pairs(prints.unionByName(prints.select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp"))))
    assert "Broadcast" not in planned(found)
    assert found.filter("distance = 2").count() == 3000


def test_a_large_table_is_dealt_out_by_value(spark, monkeypatch):
    prints = spark.range(0, 500, 1, 4).select(F.xxhash64("id").alias("fp"))
    prints = prints.unionByName(prints.select(F.col("fp").bitwiseXOR(F.lit(1 << 40 | 9)).alias("fp")))
    want = sorted(map(tuple, dedup.near_pairs(prints).collect()))
    monkeypatch.setattr(dedup, "PART", 100)
    assert sorted(map(tuple, dedup.near_pairs(prints).collect())) == want and len(want) >= 500


def test_many_pairs_of_one_block_are_compared_in_bounded_memory(monkeypatch):
    prints = np.arange(700, dtype=np.uint64)
    want = sum(1 for i in range(700) for j in range(i) if (i ^ j).bit_count() <= 3)
    monkeypatch.setattr(dedup, "PAIRS_AT_ONCE", 100)
    got = {tuple(sorted(p)) for x, y in dedup._met(prints, 1 << 63, 3) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert len(got) == want
