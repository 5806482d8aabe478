import re
from collections import Counter

from pyspark.sql import functions as F

from webskein.llm import quality_rules as q

from .conftest import ODD


def base(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count = Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed


GIVEN = [
    *ODD,
    (20, "a b c a b c a b"),
    (21, "x y\nx y\n\n \nx y\n z"),
    (22, "one two three " * 2 + " ".join(f"w{i}" for i in range(100)) + " one two three"),
    (23, "THIS IS LOUD!! " + " ".join(f"LOUD{i}!!" for i in range(100))),
    (24, " ".join(f"w{i}###" for i in range(100))),
    (25, " ".join(f"word{i}" for i in range(100)) + "   end\x0b\x1c\x85x"),
    (26, "\n".join(["the same line"] * 9 + [f"another line {i}" for i in range(12)])),
]


def test_counts_equal_brute_force(spark, rows):
    got = q.measured(rows(GIVEN, "kept")).collect()
    as_rows = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter((r.doc_id, as_rows(r)) for r in got) == Counter((i, base(t)) for i, t in GIVEN)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[25] and kept[22] and not any(kept[i] for i in (20, 21, 23, 24, 26, 1, 2, 4))
    assert not any(r.kept and r.base_failed for r in got)
    assert q.measured(rows([], "kept")).count() == 0


def test_cascade_agrees_and_orders_by_worth(spark, rows):
    given = rows(GIVEN, "kept")
    want = Counter((r.doc_id, r.kept) for r in q.measured(given).collect())
    assert Counter((r.doc_id, r.kept) for r in q.cascade(given).collect()) == want
    assert q.ordered({"never": 0.1, "nearly the same": 10.0, "always": 9.0}) == ["nearly the same", "always", "never"]
    docs = spark.createDataFrame([(i, "! " * 60) for i in range(200)], "doc_id bigint, text string")
    worth = q.worths(docs)
    assert len(worth) == len(q.rules(F.lit(""), F.array())) and max(worth["shouting"], worth["word length"]) > 10 * worth["few words"]


def test_a_rejected_document_costs_no_further_rule(spark, rows):
    text = F.col("text")
    fails = q.Rule("fails", F.raise_error(F.lit("evaluated")).cast("boolean"))
    first = [r for r in q.rules(text, q.words(text)) if r.name == "few words"]
    assert rows([(1, "a b")]).select(q.verdict([*first, fails]).alias("v")).first().v == "few words"


def test_main_path_is_native(spark, rows):
    plan = q.measured(rows(GIVEN, "kept"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
