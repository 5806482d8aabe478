import random
import re
import tracemalloc
from pathlib import Path
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from webskein.llm import byte_bpe, common
from webskein.llm import jaccard_join as q

from .conftest import ODD


def sets_of(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k=4, percent=85):
    sets = [sets_of(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None:
                both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                if either and 100 * both >= percent * either or a == b and sets[i] and sets[j]:
                    up[top(i)] = top(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[top(i)] = min(a, least.get(top(i), a))
    return sorted((str(a), len(s), str(least[top(i)] if a is not None else None)) for i, ((a, _), s) in enumerate(zip(rows, sets)))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def family(rnd, n, words, edits):
    base = [f"w{rnd.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(50)}"
        out.append(" ".join(w[: len(w) - rnd.randrange(3)]))
    return out


@pytest.mark.parametrize("frequent,very", [(8, 512), (1, 4), (0, 0)])
def test_random_families_equal_brute_force(spark, rows, frequent, very):
    rnd = random.Random(frequent)
    passage = " ".join(f"p{i}" for i in range(30))
    given = [t for n, w, e in ((40, 120, 4), (25, 30, 2), (12, 300, 9), (30, 7, 1), (6, 3, 1), (3, 60, 0)) for t in family(rnd, n, w, e)]
    given += [passage + " " + " ".join(f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(60))) for _ in range(40)]
    given = list(enumerate(given))
    rnd.shuffle(given)
    got = q.near_duplicates(rows(given, "node"), frequent=frequent, very_frequent=very)
    assert result(got) == brute(given)
    few = q.near_duplicates(rows(given, "node"), frequent=frequent, very_frequent=very, frequent_tokens_most=5)
    assert result(few) == brute(given)


def test_other_shingles_and_thresholds(spark, rows):
    rnd = random.Random(2)
    given = list(enumerate(t for n, w, e in ((20, 80, 6), (20, 20, 2)) for t in family(rnd, n, w, e)))
    assert result(q.near_duplicates(rows(given, "node"), words=5, percent=80)) == brute(given, 5, 80)


def test_every_link_is_counted(spark, rows):
    rnd = random.Random(7)
    given = list(enumerate(t for n, w, e in ((30, 100, 5), (10, 20, 1), (4, 50, 0)) for t in family(rnd, n, w, e)))
    sets = [sets_of(t) for _, t in given]
    linked = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    want = {i: sum(linked(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)}
    assert {r.doc_id: r.links for r in q.link_counts(rows(given, "node")).collect()} == want


def test_sets_that_share_a_digest_are_told_apart(spark, rows):
    whole = q.digests
    rnd = random.Random(8)
    given = list(enumerate(t for n, w, e in ((12, 100, 3), (6, 20, 1), (4, 50, 0)) for t in family(rnd, n, w, e)))
    with mock.patch.object(q, "digests", lambda s: (whole(s)[0] % 3, whole(s)[1])):
        # the workers' module isn't patched, so the parts that run there are called here
        assert q.node_of(np.arange(5, dtype=np.uint64), frozenset({0, 1, 2})) == whole(np.arange(5, dtype=np.uint64))[1]
    members = spark.createDataFrame([(i, 1, i % 3, i) for i in range(9)] + [(9, 1, 7, 1), (10, 1, 7, 1)], "doc_id bigint, n bigint, node bigint, second bigint")
    assert q.shared_digests(members) == {0, 1, 2}
    with mock.patch.object(q, "shared_digests", lambda members: frozenset(r.node for r in members.filter("node is not null").collect())):
        assert result(q.near_duplicates(rows(given, "node"))) == brute(given)  # every set goes by its second digest


def test_odd_rows(spark, rows):
    given = [*ODD, (30, "Word"), (31, "one two three four five"), (32, "ONE two\nthree four  five"), (33, "one two three four five six"), (6, "another text of the same id as six"), (None, "one two three four five")]
    assert result(q.near_duplicates(rows(given, "node"))) == brute(given)
    assert q.near_duplicates(rows([], "node")).count() == 0


def test_prefixes_share_an_entry():
    """Any two similar enough sets share an index entry, whatever the tokens' classes."""
    rng = np.random.default_rng(4)
    for trial in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        cut = int(rng.integers(0, len(a) // 10 + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 12 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        kind = lambda t: ((t >> np.uint64(7)) % np.uint64(1 + trial % 3)).astype(np.int8)  # noqa: B023, E731
        assert len(np.intersect1d(q.signatures(a, kind(a), 85), q.signatures(b, kind(b), 85)))


def test_a_large_family_has_no_row_or_entry_per_pair(spark):
    known = spark.createDataFrame([(s, i, 100, i, i % 3, size) for s in range(3) for i in range(600) for size in [0]], "signature bigint, node bigint, n bigint, part bigint, block bigint, size bigint")
    got = q.candidate_blocks(known, 80, True).collect()
    assert sorted((r.ba, r.bb) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    assert all(len(r.a) == len(r.b) == 200 * 8 and not r.whole for r in got)
    got = q.candidate_blocks(known.selectExpr("signature", "node", "n", "part", "block", "200L AS size"), 80, True).collect()
    assert len(got) == 6 and all(r.whole and not r.a and not r.b and not r.nodes for r in got)


def test_families_of_many_blocks_equal_brute_force(spark, rows):
    rnd = random.Random(11)
    given = list(enumerate(t for n, w, e in ((70, 120, 12), (30, 40, 3)) for t in family(rnd, n, w, e)))
    with mock.patch.multiple(q, BLOCK_NODES=4, MANY_BLOCKS=3, LARGE_BLOCK_NODES=16):
        assert result(q.near_duplicates(rows(given, "node"), words=5, percent=80)) == brute(given, 5, 80)


def test_products_of_matrices_equal_intersections():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    make = lambda k: [np.unique(np.concatenate([base[rng.random(150) < 0.9], rng.integers(0, 40, 5).astype(np.uint64)])) for _ in range(k)]
    for a, b in ((make(90), make(70)), (make(3), make(4)), (make(1), make(40))):
        both = [[len(np.intersect1d(s, t)) for t in b] for s in a]
        assert (q.shared_tokens(a, b) == both).all()
        want = np.array([[100 * c >= 80 * (len(s) + len(t) - c) for t, c in zip(b, row)] for s, row in zip(a, both)])
        assert (q.linked(a, b, 80) == want).all()
        x, y = q.spanning(want, np.arange(len(a)), len(a) + np.arange(len(b)))
        assert want[x, y].all() and len(x) < len(a) + len(b)


def test_a_task_drops_what_packing_left_in_its_worker(spark):
    class Docs:
        select = filter = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run  # noqa: E731, N815

    byte_bpe.vocabulary(byte_bpe.VOCABULARY, True).packed(["some words"])
    assert byte_bpe.vocabulary.cache_info().currsize
    batch = pa.record_batch({"doc_id": pa.array([1, 2], pa.int64()), "text": ["one two three four five", ""]})
    (got,) = q.nodes(Docs(), 4)(iter([batch]))
    assert got.column("n").to_pylist() == [2, 0]
    assert not byte_bpe.vocabulary.cache_info().currsize


@pytest.mark.skipif(common._TRIM is None, reason="another C library than glibc")
def test_free_memory_is_given_back():
    resident = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
    held = [bytes(2000) for _ in range(100_000)]
    held = held[-1:]  # what lies before it isn't at the end of the heap
    before = resident()
    common.give_back()
    assert resident() < before - 100 and len(held) == 1


def test_distinct_rows_take_less_than_a_copy():
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 300, 1_000_000) for _ in range(4)]
    want = np.unique(np.stack([rows[k] for k in (0, 1, 3, 2)], axis=1)[:5000], axis=0)
    assert (np.stack(q._distinct([x[:5000] for x in rows]))[[0, 1, 3, 2]].T == want).all()
    rows = [rng.integers(0, 300, 1_000_000) for _ in range(4)]
    tracemalloc.start()
    rows = [x.copy() for x in rows]
    q._distinct(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 4 * 8_000_000
