import random
import re
from collections import Counter

from webskein.llm import license_scan as q

from .conftest import ODD

RULES = q.signature_rules()
GIVEN = [
    *ODD,
    (20, "CC BY 4.0 and cc-by, cc\n\n by; the GNU General  Public License. All rights reserved."),
    (21, "x " * 500 + "Licensed under CC BY-NC 4.0." + " y" * 10),
    (22, "This work is licensed under the GNU General Public License, version 3."),
    (23, "éCC by Écc BY ccby cc bye"),
    (24, "all rights reserved " * 3000),
    (25, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License. \x01 \x02 Copyright 2020 A B"),
    (26, "SPDX-License-Identifier: Apache 2.0; Apache License; public domain, CC0 1.0"),
    (27, "mit der lizenz, the licence of the mit license"),
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in q.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined = " " + " ".join(words) + " "
    spans = []
    if re.search("|".join(q.ROOTS) + "|cc by", joined):
        for r in RULES:
            if not r.base and r.keyword in joined:
                at = [0]
                for c in joined:
                    at.append(at[-1] + (c == " "))
                spans += [(at[m.start()] - 1, at[m.end()] - 1, r) for m in re.finditer(r.pattern, joined)]
    spans.sort(key=lambda s: (s[0], -s[1], -s[2].priority, s[2].number))
    high, stays = {}, []
    for a, b, r in spans:
        if not any(end >= b for p, end in high.items() if p >= r.priority):
            stays.append(r)
        high[r.priority] = max(high.get(r.priority, -1), b)
    base = {label for _, label in places}
    at = [i for i, _ in places]
    weights = [r.weight for r in stays] + [0.5] * bool(places)
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for r in stays})), max(weights, default=0.0)


def as_row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


def test_rules_are_many_and_gated():
    assert len(RULES) > 200
    for r in RULES:
        forced = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\?", "", r.pattern)
        assert any(x in r.keyword for x in q.ROOTS) or r.keyword.startswith("cc by") or "licen[cs]e" in forced, r


def test_scan_equals_brute_force(spark, rows):
    got = q.scan(rows(GIVEN, "label")).collect()
    assert Counter((r.doc_id, as_row(r)) for r in got) == Counter((i, brute(t)) for i, t in GIVEN)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[21] == "cc-by,cc-by-nc" and labels[22] == "gpl,gpl-3.0" and labels[27] == "mit"
    assert q.scan(rows([], "label")).count() == 0


def test_random_texts(spark, rows):
    rnd = random.Random(5)
    bits = ["licensed under", "the", "mit", "apache", "license", "2.0", "CC", "BY", "nc", "gnu", "general public license", "version", "3", "All rights", "reserved", "copyright 2001", "gpl", "lesser", "public", "domain", "x"]
    given = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))) for i in range(150)]
    got = q.scan(rows(given, "label")).collect()
    assert {r.doc_id: as_row(r) for r in got} == {i: brute(t) for i, t in given}


def test_documents_and_native_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = q.scan(docs)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    assert {r.doc_id: as_row(r) for r in got.collect()} == {r.doc_id: brute(r.text) for r in docs.collect()}
