import math
import zlib
from collections import Counter
from unittest import mock

import numpy as np
import pytest
import zstandard

from webskein.llm import quality_classifier as q

from .conftest import ODD


def auc(scores, labels):
    order = np.argsort(scores)
    y = np.array(labels)[order]
    ranks, p = np.arange(1, len(y) + 1), y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 500 and auc(*zip(*held)) > 0.99
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.98
    assert np.mean([s >= 0.5 for s, y in held if y]) > 0.99


def test_held_out_labels_are_never_learnt(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " + ("good words here " if i % 2 else "### bad %%% ") * 9) for i in range(300)], "doc_id bigint, text string")
    rows = [(i, i % 2) for i in range(300)]
    changed = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in rows]
    scores = [{r.doc_id: r.score for r in q.classify(docs, spark.createDataFrame(x, "doc_id bigint, quality int")).collect()} for x in (rows, changed)]
    assert scores[0] == scores[1] and auc([scores[0][i] for i in range(300)], [i % 2 for i in range(300)]) == 1


def test_odd_rows(spark, rows):
    labels = spark.createDataFrame([(5, 1, "x"), (6, 0, "x"), (5, 1, "x"), (4, 0, "x"), (4, 1, "x"), (None, 1, "x"), (99, None, "x"), (77, 1, "x")], "doc_id bigint, quality int, text string")
    got = q.classify(rows(ODD, "score"), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in q.classify(rows(ODD, "score"), labels.limit(0)).collect()} == {0.5}
    assert q.classify(rows([], "score"), labels).count() == 0


def test_scores_equal_a_plain_version(spark, rows):
    good, bad = b"plain words of good prose, one after the other. " * 40, b"buy!! $$$ now >>> click " * 60
    mean, scale, weights = np.linspace(0, 1, 8), np.linspace(1, 2, 8), np.linspace(-1, 1, 9)

    def plain(text):
        data, sizes = (text or "").encode(), []
        for words in (good, bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[i : i + 4096])) for i in range(0, max(1, len(data)), 4096)))
        g, b = sizes
        n, d = len(data) + 32, (b - g) / (b + g)
        x = [d, g / n, b / n, math.log(n) - 7, d * (math.log(n) - 7), abs(d), d * g / n, (g / n) ** 2]
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, mean, scale)]
        return 1 / (1 + math.exp(-(weights[0] + sum(w * v for w, v in zip(weights[1:], z)))))

    got = q.score(rows(ODD, "score"), q.Model(good, bad, mean, scale, weights)).collect()
    want = {}
    for i, t in ODD:
        want.setdefault(i, []).append(plain(t))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(r.score)
    assert have.keys() == want.keys() and all(sorted(have[i]) == pytest.approx(sorted(want[i]), abs=1e-9) for i in want)


def test_the_fit_s_bytes_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 2000) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    with mock.patch.object(q, "SAMPLE_BYTES", 30_000), mock.patch.object(q, "fit", lambda good, bad, known: (good, bad, known)):
        good, bad, known = q.learn(docs, labels)
    assert good and bad and known and sum(map(len, good + bad)) + sum(len(t) for t, _ in known) <= 60_000
