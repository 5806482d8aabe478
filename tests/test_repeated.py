"""Pages of one URL are pages of their own: queries against their SQL over tables that repeat URLs."""

import duckdb
import pytest

from webskein import registry

HTML = '<html lang="{}"><head><title>t</title></head><body><a href="/{}">x</a><p>{}</p></body></html>'
TEXTS = {"de": "Der Hund und die Katze gehen durch das Haus und der Garten ist nicht weit", "en": "The dog and the cat walk through the house and the garden is not far away"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    rows = [(i, f"https://a.example.com/{i % 4}", HTML.format(lang, i % 3, TEXTS[lang] * 3)) for i, lang in enumerate(["de", "en"] * 6)]
    rows += [(12, "https://a.example.com/1", rows[1][2]), (13, None, rows[1][2])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, TEXTS[lang] * 5, lang) for i, lang in enumerate(["de", "en"] * 5)], "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return str(folder), con


def equal(spark, tables, name):
    folder, con = tables
    got = registry.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))


def test_a_url_is_looked_up_once(spark, tables):
    equal(spark, tables, "page_lookup")


def test_social_links_of_each_page(spark, tables):
    equal(spark, tables, "social_links")


def test_languages_of_each_page(spark, tables):
    equal(spark, tables, "page_languages")
