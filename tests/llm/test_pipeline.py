import shutil

from webskein.llm import jaccard_join, packing, quality_classifier, quality_rules

import corpus_pipeline

from .test_jaccard_join import brute as components
from .test_packing import check
from .test_quality_rules import base

DIR = "/root/testdata/sf0.01"


def test_each_stage_works_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    (_, rules), (_, classifier), (_, duplicates), (_, last) = corpus_pipeline.STAGES
    one = rules(spark, docs, DIR).cache()
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == columns and kept == {r.doc_id for r in quality_rules.measured(docs).collect() if r.kept}
    assert not any(base(rows[i].text)[-1] for i in kept)
    two = classifier(spark, one, DIR).cache()
    scores = {r.doc_id: r.score for r in quality_classifier.classify(docs, spark.read.parquet(f"{DIR}/labels.parquet")).collect()}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {i for i in kept if scores[i] >= 0.5}
    three = duplicates(spark, two, DIR).cache()
    given = [(r.doc_id, r.text) for r in two.collect()]
    assert three.columns == columns and {str(r.doc_id) for r in three.collect()} == {c for _, _, c in components(given, 5, 80)}
    assert all(r == rows[r.doc_id] for r in three.collect())
    check([(r.doc_id, r.text) for r in three.collect()], last(spark, three, DIR).collect())
    for df in (docs, one, two, three):
        df.unpersist()


def test_good_documents_stay(spark):
    got = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").select("doc_id").distinct().collect()}
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    groups = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    fit = {r.doc_id for r in docs.collect() if not base(r.text)[-1]}
    good = {i for i in fit if quality.get(i) == 1 and groups[i] == i}
    assert len(good & got) >= 0.98 * len(good)
    assert sum(quality.get(i) == 0 for i in got) <= 2


def test_odd_documents(spark, tmp_path):
    rows = [(i, t, None, "s", 1) for i, t in ((1, None), (2, ""), (None, "some words " * 40), (3, " ".join(f"w{i}" for i in range(100))), (3, " ".join(f"w{i}" for i in range(100))))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {3} and sum(r.length for r in got) == got[0].doc_tokens
    shutil.rmtree(tmp_path / "documents.parquet")
    spark.createDataFrame(rows[:0], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert packing.LENGTH == 2048


def test_near_duplicates_share_80_percent_of_five_word_shingles(spark):
    words = [f"w{i}" for i in range(100)]
    edited = lambda *places: " ".join("edited" + w if i in places else w for i, w in enumerate(words))
    given = [(1, edited()), (2, edited(30, 70)), (3, edited(20, 45, 80)), (4, " ".join(f"v{i}" for i in range(100)))]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, DIR).collect()}
    assert got == {1, 3, 4} and {str(i) for i in got} == {c for _, _, c in components(given, 5, 80)}
    assert {c for _, _, c in components(given)} == {"1", "2", "3", "4"}  # by the op4 query's values the second stays


def test_unlike_texts_of_one_id_stay_and_like_ones_without_id_are_one(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    given = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (2, text("d")), (5, text("e")), (4, text("e"))]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, DIR).collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (4, "e")], key=str)


def test_near_duplicate_stage_equals_brute_force_over_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    stay = corpus_pipeline.near_duplicate_stage(spark, docs, DIR).cache()
    assert {str(r.doc_id) for r in stay.collect()} == {c for _, _, c in components(given, 5, 80)}
    assert all(r == rows[r.doc_id] for r in stay.collect())
    check([(r.doc_id, r.text) for r in stay.collect()], corpus_pipeline.packing_stage(spark, stay, DIR).collect())
    stay.unpersist()
