r"""Quality rules in a short-circuit cascade, built of DataFrame functions only.

A rule is a condition on the text that rejects a document. `ordered` takes a sample of about SAMPLE_ROWS rows by a hash
of their places in the whole table, times each rule on it (the least of RUNS runs, less an empty one), counts what it
rejects, and sorts the rules by rejections per second, in steps of a factor of STEP so that the order is stable.
`cascade` chains them in that order in one CASE expression whose branches hold the rules' own counts, so a later rule
isn't evaluated for a document that an earlier one has rejected. The order changes cost only: a document is kept if no
rule rejects it. `measured` takes its verdict from the same cascade; the counts that it returns are computed beside it.

Null texts count as empty and are rejected (no words). Texts of any length are read whole; within a text everything is
hashing, or sorting of its own three-word windows. Every input row gives one row, also with null or repeated ids;
columns of other names don't matter (`cascade` keeps all of them, and replaces `kept`). An empty table gives an empty one.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, written

#: Rows of the sample from which costs and rejections are estimated, runs of each rule, factor within which rules are equal.
SAMPLE_ROWS, RUNS, STEP = 1000, 3, 10
#: White space between words: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 6
MAX_DUP_LINE_PERCENT = 30
MIN_DUP_LINES = 4
MAX_SHOUT_PERCENT = 30
MAX_MEAN_WORD, MIN_MEAN_WORD = 20, 2


def bind(value: Column, use) -> Column:
    """use(value), with value evaluated once: a column named in a lambda would be evaluated for every element."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text, as array<string>; empty for a text without words."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")


def n_dup_lines(text: Column) -> Column:
    return bind(_worded_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"))


def n_repeat_words(ws: Column) -> Column:
    """Words in three-word windows that the array has twice or more."""

    def covered(at: Column) -> Column:
        """Words covered by windows at these sorted places."""
        steps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p, k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        found = bind(pairs, lambda p: F.filter(F.transform(p, lambda x, k: F.when(same(p, k - 1, x) | same(p, k + 1, x), x["i"])), lambda i: i.isNotNull()))
        return bind(F.sort_array(found), covered)

    def of(v: Column) -> Column:
        starts = F.slice(v, 1, F.size(v) - 2)
        windows = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(v, i + 1), F.get(v, i + 2)))
        return bind(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(places(t)))

    return bind(ws, lambda v: F.when(F.size(v) < 3, 0).otherwise(of(v))).cast("bigint")


def shouting_percent(text: Column) -> Column:
    """Capital letters A-Z and exclamation marks, of all characters, in percent."""
    return F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z!]+", "")) / F.greatest(F.length(text), F.lit(1))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules(text: Column, ws: Column) -> list[Rule]:
    """The rules, from a text that isn't null and its words. Rules that are worth the same are run in this order."""
    n_words, word_chars, dup_lines = F.size(ws), F.length(F.array_join(ws, "")), n_dup_lines(text)
    return [
        Rule("few words", n_words < MIN_WORDS),
        Rule("shouting", shouting_percent(text) > MAX_SHOUT_PERCENT),
        Rule("symbols", 100 * n_symbols(text) > MAX_SYMBOL_PERCENT * word_chars),
        Rule("repeated lines", (dup_lines >= MIN_DUP_LINES) & (100 * dup_lines > MAX_DUP_LINE_PERCENT * F.size(F.split(text, "\n")))),
        Rule("repeated words", 100 * n_repeat_words(ws) > MAX_REPEAT_PERCENT * n_words),
        Rule("word length", (word_chars > MAX_MEAN_WORD * n_words) | (word_chars < MIN_MEAN_WORD * n_words)),
    ]


def worths(docs: DataFrame, *, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Rejected rows a second of each rule on a sample over the whole table; what a rule gets for nothing (the words) costs it nothing."""
    every = max(1, docs.count() // sample_rows)
    safe = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chosen = docs.select(safe.alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)).alias("at")).filter("at = 0")
    sample, folder = written(chosen.select("text", words(F.col("text")).alias("ws")).repartition(1), "rules-sample")

    def seconds(condition: Column) -> tuple[float, int]:
        best = math.inf
        for _ in range(RUNS):
            began = time.perf_counter()
            found = sample.select(F.count_if(condition)).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, found

    empty, _ = seconds((F.col("text") == "-") & (F.size("ws") == 0))
    out = {}
    for rule in rules(F.col("text"), F.col("ws")):
        took, rejected = seconds(rule.rejects)
        out[rule.name] = (rejected + 0.5) / max(took - empty, empty / 10)
    delete(docs.sparkSession, folder)
    return out


def ordered(worth: dict[str, float]) -> list[str]:
    """The rules' names, those with the most rejections a second first."""
    best = max(worth.values(), default=1)
    return sorted(worth, key=lambda name: round(math.log(best / worth[name], STEP)))


def verdict(given: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(given):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def rejection(text: Column, order: list[str]) -> Column:
    """The first rule in this order that rejects the text, else null; the text is cut into words once, whichever rules need them."""

    def of(ws: Column) -> Column:
        by_name = {r.name: r for r in rules(text, ws)}
        return verdict([by_name[n] for n in order])

    return bind(words(text), of)


def cascade(docs: DataFrame, *, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows with `kept`: true where no rule rejects."""
    order = ordered(worths(docs, text=text, sample_rows=sample_rows))
    return docs.withColumn("kept", rejection(F.coalesce(F.col(text).cast("string"), F.lit("")), order).isNull())


def measured(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id with the base counts, base_failed, and the cascade's verdict."""
    order = ordered(worths(docs, sample_rows=sample_rows))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def counts(ws: Column) -> Column:
        given = {"n_words": F.size(ws), "word_chars": F.length(F.array_join(ws, "")), "n_symbols": n_symbols(F.col("text")), "n_dup_lines": n_dup_lines(F.col("text")), "n_repeat_words": n_repeat_words(ws)}
        return F.struct(*(c.cast("bigint").alias(n) for n, c in given.items()))

    seen = base.select("doc_id", bind(words(F.col("text")), counts).alias("c"), rejection(F.col("text"), order).isNull().alias("passed"))
    # bound once more, so that a filter on a result doesn't count each part again
    failed = lambda c: (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    judged = seen.select("doc_id", bind(F.struct("c", "passed"), lambda x: F.struct(x["c"].alias("c"), failed(x["c"]).alias("base_failed"), (x["passed"] & ~failed(x["c"])).alias("kept"))).alias("seen"))
    return judged.select("doc_id", "seen.c.*", "seen.base_failed", "seen.kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
v AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda j: ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2])) AS k FROM w WHERE len(ws) > 2),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM v) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) t(o) GROUP BY r),
c AS (
  SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 6 * word_chars
    OR n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * len(string_split(text, chr(10)))
    OR 100 * (length(text) - length(regexp_replace(text, '[A-Z!]', '', 'g'))) > 30 * greatest(length(text), 1)
    OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM c
"""
