"""TIFF columns: write 8-bit grey pages, and walk, decode and list the pages of TIFF files.

Reading handles both byte orders, chains of image directories (a chain that loops ends), strips and tiles, 8- and
16-bit samples, no compression, LZW, deflate and PackBits, and horizontal predictors. Each page is a row. Whatever else
a file says (another predictor or compression, places outside the file, strips that decode to too few bytes, pages of
more than PAGE_BYTES) is an error: `read` raises ValueError, before anything is allocated for it, and `pages` gives a
row with the error after the rows of the file's good pages. A null file has no rows; an empty one has an error.

`round_trip` treats a null text as empty, and pads each payload with zero bytes to a positive multiple of 64. The form of
the file (compression, predictor, strips or tiles, byte order) is chosen by a checksum of the payload, so that equal
texts give equal values and all forms are used. Payloads longer than PAGE_ROWS rows are stored as several pages. The
rows of a file's pages follow each other and are gathered where they arise. Every row gives one row.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WIDTH = 64
PAGE_ROWS = 16384
STRIP_ROWS = 1024
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of a decoded page up to which it is read.
PAGE_BYTES = 1 << 28
#: The most bytes that a byte of each compression can stand for.
_RATIO = {NONE: 1, LZW: 2600, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
#: Sizes of the field types 1 to 12 of the format.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def packbits_encode(data: bytes) -> bytes:
    a = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(a.astype(np.int16), prepend=-1))
    size = np.diff(np.append(edge, len(a)))
    out, at = bytearray(), 0

    def literal(to: int) -> None:
        for i in range(at, to, 128):
            part = data[i : min(i + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for first, run in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        literal(first)
        for i in range(0, run, 128):
            n = min(128, run - i)
            out.extend((257 - n if n > 1 else 0, data[first]))
        at = first + run
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    out, bits, n_bits = bytearray(), 256, 9  # the first code clears the table
    longer: dict[int, int] = {}  # code and byte -> code of both
    following, width, code = 258, 9, -1
    for b in data:
        if code < 0:
            code = b
            continue
        key = code << 8 | b
        if (found := longer.get(key)) is not None:
            code = found
            continue
        bits, n_bits = bits << width | code, n_bits + width
        longer[key] = following
        following += 1
        if following == 4095:
            bits, n_bits = bits << width | 256, n_bits + width
            longer, following, width = {}, 258, 9
        elif following in (512, 1024, 2048):
            width += 1
        code = b
        if n_bits >= 512:
            rest = n_bits % 8
            out += (bits >> rest).to_bytes(n_bits // 8, "big")
            bits, n_bits = bits & ((1 << rest) - 1), rest
    if code >= 0:
        bits, n_bits = bits << width | code, n_bits + width
        if following + 1 in (512, 1024, 2048):
            width += 1
    bits, n_bits = bits << width | 257, n_bits + width
    out += (bits << -n_bits % 8).to_bytes(-(-n_bits // 8), "big")
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, bits, n_bits, width, at = bytearray(), 0, 0, 9, 0
    words: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    last = b""
    while len(out) < size:
        while n_bits < width:
            if at >= len(data):
                return bytes(out)
            bits, n_bits, at = bits << 8 | data[at], n_bits + 8, at + 1
        n_bits -= width
        code = bits >> n_bits
        bits &= (1 << n_bits) - 1
        if code == 257:
            break
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += word
        if last:
            words.append(last + word[:1])
            width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
        last = word
    return bytes(out[:size])


def write(payload: bytes, *, width: int = WIDTH, compression: int = DEFLATE, predictor: int = 2, order: str = "<", page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, tile: int = 0) -> bytes:
    """A TIFF file of 8-bit grey pages whose samples, in order, are the payload (whole rows)."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    pack = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}[compression]

    def differenced(block: np.ndarray) -> bytes:
        if predictor != 2:
            return block.tobytes()
        d = block.copy()
        d[:, 1:] -= block[:, :-1]
        return d.tobytes()

    for first in range(0, len(rows), page_rows):
        page = rows[first : first + page_rows]
        blocks = []
        if tile:
            for y in range(0, len(page), tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile), dtype=np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(pack(differenced(block)))
        else:
            blocks = [pack(differenced(page[y : y + strip_rows])) for y in range(0, len(page), strip_rows)]
        places = []
        for block in blocks:
            places.append(len(out))
            out += block
        fields: list[tuple[int, int, list[int]]] = [(256, 4, [width]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        if tile:
            fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, list(map(len, blocks)))]
        else:
            fields += [(273, 4, places), (278, 4, [strip_rows]), (279, 4, list(map(len, blocks)))]
        entries = []
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The fields of the directory at a place, and the place of the next one."""
    if at + 2 > len(data):
        raise ValueError("a directory lies outside the file")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 6 + 12 * n > len(data):
        raise ValueError("a directory is cut off")
    fields: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code, place = {1: "B", 3: "H", 4: "I"}.get(kind), at + 10 + 12 * i
        if not code:
            continue
        if (size := _SIZES[kind] * count) > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size > len(data):
            raise ValueError("a field lies outside the file")
        fields[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _block(raw: bytes, compression: int, want: int) -> bytes:
    """The first `want` bytes that a strip or tile decodes to."""
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            raw = zlib.decompressobj().decompress(raw, want)
        except zlib.error as e:
            raise ValueError(f"deflate: {e}") from None
    elif compression == LZW:
        raw = lzw_decode(raw, want)
    elif compression == PACKBITS:
        raw = packbits_decode(raw, want)
    if len(raw) < want:
        raise ValueError("a strip or tile is too short")
    return raw[:want]


def _page(data: bytes, fields: dict[int, list[int]], order: str) -> dict:
    get = lambda tag, other: (fields.get(tag) or [other])[0]
    width, height, bits, samples = get(256, 0), get(257, 0), get(258, 8), get(277, 1)
    compression, predictor = get(259, NONE), get(317, 1)
    if not (width and height and samples):
        raise ValueError("a page has no samples")
    if bits not in (8, 16) or len(set(fields.get(258, []))) > 1 or get(284, 1) != 1:
        raise ValueError("samples of 8 or 16 bits, stored pixel by pixel, are read")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't read")
    if compression not in _RATIO:
        raise ValueError(f"compression {compression} isn't read")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    tiled = 324 in fields
    tall, wide = (get(323, 0), get(322, 0)) if tiled else (min(get(278, height), height), width)
    places, sizes = (fields[324], fields.get(325, [])) if tiled else (fields.get(273, []), fields.get(279, []))
    if not (tall and wide):
        raise ValueError("strips or tiles have no size")
    across, down = -(-width // wide), -(-height // tall)
    if not len(places) == len(sizes) == across * down:
        raise ValueError("the number of strips or tiles is wrong")
    pixel = samples * kind.itemsize
    if across * down * tall * wide * pixel > PAGE_BYTES:
        raise ValueError("a page is too large")
    wants = [(tall if tiled else min(tall, height - i // across * tall)) * wide * pixel for i in range(len(places))]
    for p, s, want in zip(places, sizes, wants, strict=True):
        if p + s > len(data) or want > _RATIO[compression] * s:
            raise ValueError("a strip or tile lies outside the file or is too short")
    image = np.empty((height, width, samples), dtype=kind)
    for i, (p, s, want) in enumerate(zip(places, sizes, wants, strict=True)):
        y, x = i // across * tall, i % across * wide
        block = np.frombuffer(_block(bytes(data[p : p + s]), compression, want), dtype=kind).reshape(-1, wide, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        image[y : y + tall, x : x + wide] = block[: height - y, : width - x]
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": compression, "predictor": predictor, "data": image.tobytes()}


def read(data: bytes) -> Iterator[dict]:
    """The pages of a TIFF file: page, width, height, bits, samples, compression, predictor and data (the samples, rows first)."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        fields, after = _fields(data, at, order)
        yield {"page": len(seen) - 1} | _page(data, fields, order)
        at = after


_NUMBERS = ("page", "width", "height", "bits", "samples", "compression", "predictor")


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page of each file in the column media: its numbers, data and error, after the other columns."""
    for b in batches:
        others = [n for n in b.schema.names if n != "media"]
        for i, file in enumerate(b.column("media").to_pylist()):
            if file is None:
                continue
            row = [b.column(n).slice(i, 1) for n in others]
            page, found = 0, read(file)
            while True:
                try:
                    p = next(found, None)
                    error = None
                except ValueError as e:
                    p, error = {"page": page}, str(e)
                if p is None:
                    break
                page += 1
                yield pa.RecordBatch.from_arrays([*row, *(pa.array([p.get(n)], pa.int64()) for n in _NUMBERS), pa.array([p.get("data")], pa.binary()), pa.array([error], pa.string())], [*others, *_NUMBERS, "data", "error"])
                if error:
                    break


def pages(files: DataFrame, *, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per page of each TIFF in the binary column: key, page, width, height, bits, samples, compression, predictor, data, and error (null for good pages)."""
    kind = dict(files.dtypes)[key]
    given = files.selectExpr(f"`{key}` as key", f"cast(`{media}` as binary) as media")
    return given.mapInArrow(_page_rows, f"key {kind}, {', '.join(f'{n} bigint' for n in _NUMBERS)}, data binary, error string").withColumnRenamed("key", key)


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def form(payload: bytes) -> dict:
    """The form of a payload's file, by its checksum."""
    n = zlib.crc32(payload)
    return {"compression": (NONE, LZW, DEFLATE, PACKBITS)[n & 3], "predictor": 1 + (n >> 2 & 1), "tile": (0, 0, 16, 32)[n >> 3 & 3], "order": "<>"[n >> 5 & 1]}


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        files = [write(p, **form(p)) for p in (padded(t or "") for t in b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(files, pa.binary())], ["row", "doc_id", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's padded bytes as a TIFF file."""
    return _given(docs).mapInArrow(_stored, "row bigint, doc_id bigint, media binary").drop("row")


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


class _Gathered:
    """Digests and features of a file's pages, one after the other."""

    def __init__(self):
        self.sha, self.tail, self.size = hashlib.sha256(), b"", 0
        self.pages = self.rows = self.total = self.high = self.steps = 0
        self.low, self.forms, self.last = 255, set(), None

    def add(self, p: dict) -> None:
        data = p["data"]
        self.sha.update(data)
        self.tail, self.size = (self.tail + data[-64:])[-64:], self.size + len(data)
        samples = np.frombuffer(data, dtype=np.uint8)
        self.pages, self.rows, self.total = self.pages + 1, self.rows + p["height"], self.total + int(samples.sum(dtype=np.int64))
        self.low, self.high = min(self.low, int(samples.min())), max(self.high, int(samples.max()))
        self.steps += int(np.count_nonzero(samples[1:] != samples[:-1])) + (self.last is not None and self.last != samples[0])
        self.last = samples[-1]
        self.forms.add(f"{p['compression']}/{p['predictor']}")

    def columns(self) -> tuple:
        feature = f"pages={self.pages};form={','.join(sorted(self.forms))};rows={self.rows};sum={self.total};min={self.low};max={self.high};steps={self.steps}"
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), feature


_COLUMNS = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def _gathered(page_rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Row and what was gathered from its pages, for rows of pages of one file after the other."""
    for row, own in itertools.groupby((p for b in page_rows for p in b.to_pylist()), key=lambda p: p["row"]):
        found = _Gathered()
        for p in own:
            if p["error"]:
                raise ValueError(p["error"])
            found.add(p)
        yield row, found.columns()


def round_trip(docs: DataFrame) -> DataFrame:
    """Per row: the text stored as TIFF, its pages read back as rows, and digests and features gathered from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            given = b.column("text").to_pylist()
            first = {t or "": i for i, t in reversed(list(enumerate(given)))}
            stored = next(_stored(iter([b.take(pa.array(sorted(first.values())))])))  # each text once
            media = dict(zip(stored.column("row").to_pylist(), stored.column("media").to_pylist(), strict=True))
            read_back = dict(_gathered(_page_rows(iter([stored]))))
            rows, number = [], b.column("row").to_pylist()
            for i, t in enumerate(given):
                k = number[first[t or ""]]
                size, sha, tail, feature = read_back[k]
                rows.append((b.column("doc_id")[i].as_py(), len((t or "").encode()), size, sha, tail, len(media[k]), hashlib.sha256(media[k]).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, (_, kind) in enumerate(_COLUMNS)], [n for n, _ in _COLUMNS])

    return _given(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
