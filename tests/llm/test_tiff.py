import hashlib
import random
import struct
import tracemalloc
import zlib

import pytest

from webskein.llm import tiff

from .conftest import ODD


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [0, 16, 48])
def test_pages_come_back(compression, predictor, order, tile):
    rnd = random.Random(3)
    data = bytes(rnd.choice(b"aab") for _ in range(64 * 70)) + rnd.randbytes(64 * 50) + b"\0" * 64 * 20
    file = tiff.write(data, compression=compression, predictor=predictor, order=order, page_rows=60, strip_rows=7, tile=tile)
    pages = list(tiff.read(file))
    assert [p["height"] for p in pages] == [60, 60, 20]
    assert b"".join(p["data"] for p in pages) == data


def test_lzw_of_every_width():
    data = random.Random(1).randbytes(200000) + b"abc" * 9000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 9) == b"\x2d\x2d\x2d\x2d\x2d\x41\x2d\x2d\x2d"


def test_looping_directories_end():
    file = bytearray(tiff.write(b"\1" * 64, compression=tiff.NONE))
    at = int.from_bytes(file[4:8], "little")
    n = int.from_bytes(file[at : at + 2], "little")
    file[at + 2 + 12 * n : at + 6 + 12 * n] = at.to_bytes(4, "little")
    assert len(list(tiff.read(bytes(file)))) == 1


def test_round_trip(spark, rows):
    got = sorted(((r.doc_id or 0, r) for r in tiff.round_trip(rows(ODD)).collect()), key=lambda x: str(x))
    assert len(got) == len(ODD)
    want = {(i or 0): tiff.padded(t or "") for i, t in ODD}
    for i, r in got:
        p = want[i]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0
    assert tiff.round_trip(rows([])).count() == 0
    files = tiff.store(rows(ODD))
    assert tiff.pages(files).count() == len(ODD)
    bad = tiff.pages(spark.createDataFrame([(1, b"no"), (2, None), (3, b"")], "doc_id bigint, media binary")).collect()
    assert [(r.doc_id, r.page, r.error, r.data) for r in bad] == [(1, 0, "not a TIFF file", None), (3, 0, "not a TIFF file", None)]


def test_every_form_is_on_the_path_of_the_query(spark, rows):
    given = [(i, f"text {i} " * (i % 40)) for i in range(600)]
    got = {r.doc_id: r for r in tiff.round_trip(rows(given)).collect()}
    assert {r.feature.split(";")[1] for r in got.values()} == {f"form={c}/{p}" for c in (1, 5, 8, 32773) for p in (1, 2)}
    assert {tiff.form(tiff.padded(t))["tile"] for _, t in given} == {0, 16, 32}
    for i, t in given:
        samples, media = tiff.padded(t), tiff.write(tiff.padded(t), **tiff.form(tiff.padded(t)))
        steps = sum(a != b for a, b in zip(samples, samples[1:]))
        assert got[i].payload_sha256 == hashlib.sha256(samples).hexdigest() and got[i].media_sha256 == hashlib.sha256(media).hexdigest()
        assert got[i].feature.endswith(f"sum={sum(samples)};min={min(samples)};max={max(samples)};steps={steps}")


def test_packbits_and_deflate_of_other_encoders():
    # the example of the format's description
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")
    assert tiff.packbits_decode(packed, 24) == plain and tiff.packbits_encode(plain) == packed
    for n in range(400):
        data = bytes(random.Random(n).choices(b"ab", k=n))
        assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data and tiff.lzw_decode(tiff.lzw_encode(data), n) == data
    # a page of 4 x 2 samples of 16 bits in two deflate strips with differences, put together by hand
    strips = [zlib.compress(bytes.fromhex("0100 0100 0100 0100")), zlib.compress(bytes.fromhex("ffff 0200 0000 0000"))]
    fields = [(256, 3, 1, 4), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 8), (273, 4, 2, 8 + sum(map(len, strips))), (277, 3, 1, 1), (278, 3, 1, 1), (279, 4, 2, 16 + sum(map(len, strips))), (317, 3, 1, 2)]
    at = 24 + sum(map(len, strips))
    file = b"II*\0" + at.to_bytes(4, "little") + b"".join(strips) + struct.pack("<IIII", 8, 8 + len(strips[0]), len(strips[0]), len(strips[1])) + struct.pack("<H", 9) + b"".join(struct.pack("<HHII", *f) for f in fields) + b"\0" * 4
    (page,) = tiff.read(file)
    assert page["data"] == struct.pack("<8H", 1, 2, 3, 4, 65535, 1, 1, 1)


def test_broken_files_raise_value_errors_before_memory_is_taken():
    rnd, raised = random.Random(5), 0
    files = [tiff.write(random.Random(k).randbytes(64 * 40), compression=c, predictor=p, tile=t, page_rows=20, strip_rows=7) for k, (c, p, t) in enumerate([(1, 1, 0), (5, 2, 0), (8, 2, 16), (32773, 1, 16), (8, 1, 0)])]
    tracemalloc.start()
    for n in range(3000):
        file = bytearray(files[n % len(files)])
        for _ in range(rnd.randint(1, 3)):
            # mostly in the directories, where sizes and places are
            at = rnd.randrange(len(file)) if rnd.random() < 0.3 else len(file) - 1 - rnd.randrange(150)
            file[at] = rnd.choice((0, 1, 127, 255, rnd.randrange(256)))
        try:
            list(tiff.read(bytes(file[: rnd.choice((len(file), rnd.randrange(len(file))))])))
        except ValueError:
            raised += 1
    assert raised > 500 and tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()
    whole = tiff.write(bytes(64 * 4), predictor=2)
    at = whole.index(struct.pack("<HHI", 317, 3, 1)) + 8
    with pytest.raises(ValueError, match="predictor 3"):
        list(tiff.read(whole[:at] + b"\3" + whole[at + 1 :]))


def test_good_pages_come_before_the_error(spark):
    file = tiff.write(bytes(64 * 4), compression=tiff.NONE, page_rows=2)
    got = tiff.pages(spark.createDataFrame([(1, bytearray(file[:-40]))], "doc_id bigint, media binary")).collect()
    assert [(r.page, r.error is None) for r in got] == [(0, True), (1, False)]
