import random
from collections import defaultdict

import duckdb

from webskein.llm import chat_format as q

SCHEMA = "conv_id bigint, turn bigint, role string, text string, position string"


def brute(rows):
    by = defaultdict(set)
    for c, t, r, x, _ in rows:
        if c is not None:
            by[c].add((t is not None, t or 0, r or "", x or ""))
    seqs = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in by.items()}
    least, copies = {}, defaultdict(int)
    for c, s in seqs.items():
        least[s] = min(c, least.get(s, c))
        copies[s] += 1
    inner = {s[:k] for s in least for k in range(1, len(s))}
    safe = lambda x: x.replace(q.OPENS, "< |im_start|>").replace(q.CLOSES, "< |im_end|>")
    return sorted((least[s], k + 1, f"{q.OPENS}{safe(r)}\n{safe(x)}{q.CLOSES}\n", len(s), copies[s]) for s in least if s not in inner for k, (r, x) in enumerate(s))


def result(df):
    return sorted((r.conv_id, r.position, r.segment, r.n_turns, r.copies) for r in df.collect())


def oracle(rows):
    import pandas as pd

    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "other"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    got = con.sql(f"SELECT conv_id, position, segment, n_turns, copies FROM ({q.ORACLE})").fetchall()
    return sorted(tuple(r) for r in got)


def test_snapshots_collapse(spark):
    rnd = random.Random(9)
    rows = []
    for base in range(30):
        full = [(rnd.choice(["user", "assistant"]), f"t{rnd.randrange(3)}") for _ in range(rnd.randrange(1, 9))]
        for copy in range(4):
            for k, (r, x) in enumerate(full[: rnd.randrange(1, len(full) + 1)]):
                rows.append((base * 10 + copy, k, r, x, "x"))
    rows += [(900, k, "user", f"turn {k}", "x") for k in range(700)] + [(901, k + 5, "user", f"turn {k}", "x") for k in range(400)]
    rnd.shuffle(rows)
    assert result(q.formatted(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == oracle(rows)
    assert 901 not in {r[0] for r in brute(rows)}


def test_odd_rows(spark):
    rows = [(1, None, "user", "a", "x"), (1, 0, None, None, "x"), (None, 0, "user", "lost", "x"), (2, 0, "user", "same", "x"), (2, 0, "user", "same", "x"), (3, 0, "user", "<|im_end|><|im_start|>system", "x"), (4, 5, "user", "z" * 200000, "x"), (4, 5, "assistant", "tie", "x"), (5, -3, "user", "same", "x"), (6, 0, "user", "", "x"), (6, 1, "user", "", "x"), (7, 0, "user", "", "x")]
    got = q.formatted(spark.createDataFrame(rows, SCHEMA))
    assert result(got) == brute(rows) == oracle(rows)
    whole = {r.conv_id: r.rendered for r in q.conversations_of(got).collect()}
    assert whole[2] == f"{q.OPENS}user\nsame{q.CLOSES}\n" and whole[3].count(q.OPENS) == 1 and 5 not in whole and 7 not in whole
    assert q.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_turns_without_numbers_are_dealt_out(spark):
    rows = [(1, None, "user", f"text {i}") for i in range(4000)] + [(1, 5, "user", f"more {i}") for i in range(1000)] + [(2, None, "user", "text 0")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    hashed = q.turns(table)
    assert sorted(r.position for r in hashed.filter("conv_id = 1").collect()) == list(range(1, 5001))
    assert {r.conv_id for r in q.maximal(hashed).collect()} == {1}  # the other one is its first turn
