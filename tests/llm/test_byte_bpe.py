import base64
import hashlib
from unittest import mock

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from webskein.llm import byte_bpe

from .conftest import ODD

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def expected(text):
    ids = ENC.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_equals_rank_merging(spark, rows):
    texts = [*ODD, (10, "漢字かな" * 3000 + "。" + "漢字" * 3000), (11, "a\u00a0 \u00a0b  \u2003c \x1c d"), (12, "".join(map(chr, range(1, 0x3100))))]
    got = byte_bpe.round_trip(rows(texts)).collect()
    assert sorted(map(str, ((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == sorted(str(expected(t)) for _, t in texts)
    assert byte_bpe.round_trip(rows([])).count() == 0


def test_documents_equal_rank_merging(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: expected(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs).collect()} == want


def test_cut_texts_keep_their_ids():
    bpe = byte_bpe.vocabulary()
    text = "Some words, and 1234 numbers  with   spaces\n\nand é lines. It's so " * 300
    parts = list(bpe.cuts(text, 100))
    assert len(parts) > 50 and "".join(parts) == text
    assert [int(i) for p in parts for i in bpe.encode([p])[0]] == ENC.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b'ab1.s\u00a0\u3000。漢é"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_has_the_library_s_ids_and_offsets(text):
    bpe = byte_bpe.vocabulary()
    want = bpe.tokenizer.encode(text, add_special_tokens=False)
    for long in (2048, 4):
        with mock.patch.object(byte_bpe, "LONG", long):
            bpe.memo.clear()
            ids = bpe.encode([text])[0]
        assert ids.tolist() == want.ids == ENC.encode_ordinary(text)
    starts, ends = bpe.offsets(ids, text.encode())
    assert list(zip(starts.tolist(), ends.tolist())) == want.offsets and bpe.decode(want.ids) == text.encode()


def test_long_unbroken_texts_are_cut_before_marks():
    bpe = byte_bpe.vocabulary()
    text = "漢字仮名。" * 20_000
    assert max(map(len, bpe.pieces(text))) <= 5 and max(map(len, bpe.cuts(text, 1000))) <= 1010
    with mock.patch.object(byte_bpe, "REMEMBERED", 3):
        assert b"".join(bpe.packed([text[:1000], "a b c d e f"])) == np.array(ENC.encode_ordinary(text[:1000]) + ENC.encode_ordinary("a b c d e f"), "<u4").tobytes()


def test_latin_texts_are_cut_into_matches_of_the_pattern():
    bpe = byte_bpe.vocabulary()
    bpe.memo.clear()
    texts = ["one, one. one's  one!", "".join(c for c in map(chr, range(0x250)) if not byte_bpe._NOT_LATIN.match(c)) * 2, "y" * 5000 + " one's\n\n two", "one 漢 one, \x1c one"]
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.packed(texts)] == [ENC.encode_ordinary(t) for t in texts]
    bpe.memo.clear()
    bpe.packed(texts[:1])
    assert set(bpe.memo) == {"one", ",", " one", ".", "'s", " ", "!"}
    bpe.packed(["z" * 100])
    assert "z" * 100 not in bpe.memo


def test_offsets_and_split_characters(spark, rows):
    got = byte_bpe.encode(rows([(1, "héllo \U0001f600"), (2, None)]), offsets=True).collect()
    text = "héllo \U0001f600"
    r = next(r for r in got if r.doc_id == 1)
    assert all(text[a:b] for a, b in zip(r.starts, r.ends)) and r.ends[-1] == len(text)
    back = byte_bpe.decode(spark.createDataFrame([(1, r.ids), (2, r.ids[:-1]), (3, None)], "doc_id bigint, ids array<int>")).collect()
    assert back[0].text == text and back[1].text is None and back[1].data.decode(errors="ignore") == "héllo " and back[2].text == ""
