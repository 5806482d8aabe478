import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from webskein.llm import packing

from .conftest import ODD


def check(docs, got):
    exact = Tokenizer.from_file(packing.VOCABULARY)
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(ids) == set(pieces)
    for i, v in ids.items():
        assert sum(p.length for p in pieces[i]) == sum(map(len, v))
        if len(v) == 1:
            at = 0
            for p in sorted(pieces[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(v[0]) and p.ids_crc32 == zlib.crc32(v[0][at : at + p.length].tobytes())
                at += p.length
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= s[0].padded_length <= 2048 and (s[0].padded_length & (s[0].padded_length - 1)) == 0


def test_every_id_lies_in_one_piece(spark, rows):
    given = [*ODD, (10, "a  <|endoftext|>  b<|endoftext|>"), (None, "no id"), (None, None)]
    check(given, packing.pack(rows(given, "start")).collect())
    assert packing.pack(rows([], "start")).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    used = sum(r.length for r in got)
    assert used > 0.97 * sum({r.sequence_id: r.padded_length for r in got}.values())


def test_rows_of_one_key_are_spread(spark, rows):
    got = packing.pack(rows([(1, "the same words " * 300)] * 400, "start")).collect()
    assert len({r.sequence_id >> 32 for r in got}) == 4


def test_hilbert_keys_are_neighbours():
    side = np.arange(8)
    points = np.array([(a, b, c) for a in side for b in side for c in side])
    order = packing.hilbert(points, 3)
    assert sorted(order) == list(range(512))
    walk = points[np.argsort(order)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
