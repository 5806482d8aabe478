"""Packing along a space-filling curve.

Each document's hashed word vector is projected to three dimensions (a fixed table of random integers, so that sums
are exact), the point gets a Hilbert key, the documents are range-sorted by it, and each range is one stream of ids
that is cut every 2048 ids: neighbours on the curve share sequences. Only the last sequence of a range is not full;
it is padded to the next power of two. Rows of one key (copies) are spread by a hash of their place in the written table
of keys, so that a hot key is split between ranges. The ids are the tokenizers library's; the string of an added token
in a text is that token.

Null texts are empty, and an empty text is its closing id alone. A null doc_id stays null. Every row is packed, also
repeated ones. An empty table gives no pieces. Columns of other names aren't read. A document of any length is
encoded part by part.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import VOCABULARY, vocabulary
from .common import SPACED, document_words, folder_bytes, grouped, slices, texts, written

LENGTH = 2048
CLOSING = 1
DIMENSIONS, BITS, BINS = 3, 16, 4096
#: Bytes of the written table of keys that a range has on average.
RANGE_BYTES = 32 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint"


@functools.cache
def _projection() -> np.ndarray:
    return np.random.default_rng(7).integers(-32768, 32768, size=(BINS, DIMENSIONS)).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (rows) with `bits` bits a coordinate, by the transposed form of the curve."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(docs: list[bytes]) -> np.ndarray:
    """The Hilbert key of each text's projected mean word vector; texts without words lie in the middle."""
    table, out = _projection(), []
    for a, b in grouped(docs):
        h, at = document_words(docs[a:b], SPACED, lower=True)
        sums = np.zeros((len(h) + 1, DIMENSIONS), dtype=np.int64)
        np.cumsum(table[(h & np.uint64(BINS - 1)).astype(np.int64)], axis=0, out=sums[1:])
        n = np.diff(at)
        mean = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)[:, None]
        out.append(hilbert(np.clip(mean + 32768, 0, 65535) >> (16 - BITS)))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and curve_key of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = curve_keys(texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(keys, pa.int64())], ["doc_id", "text", "curve_key"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, text string, curve_key bigint")


def pack(docs: DataFrame, *, length: int = LENGTH, path: str = VOCABULARY) -> DataFrame:
    """One row per piece of a document in a sequence; sequence ids are unique, a range's number before its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sequence, used = vocabulary(path, True), TaskContext.get().partitionId() << 32, 0
        closing = np.array([CLOSING], dtype="<u4").tobytes()
        open_rows: list[tuple] = []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal sequence, used
            size = length if used >= length else 1 << max(0, used - 1).bit_length()
            rows.extend((*r, size) for r in open_rows)
            open_rows.clear()
            sequence, used = sequence + 1, 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            rows.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in slices(batches):
            encoded = bpe.packed([t or "" for t in b.column("text").to_pylist()])
            for doc_id, packed in zip(b.column("doc_id").to_pylist(), encoded, strict=True):
                ids = np.frombuffer(packed + closing, dtype="<u4")
                at = 0
                while at < len(ids):
                    n = min(length - used, len(ids) - at)
                    open_rows.append((doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), sequence, used))
                    at, used = at + n, used + n
                    if used == length:
                        close()
            if rows:
                yield batch()
        if open_rows:
            close()
            yield batch()

    given, folder = written(keyed(docs), "curve")  # so that the ranges' sample needs no second pass over the texts
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-folder_bytes(docs.sparkSession, folder) // RANGE_BYTES))
    placed = given.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = placed.repartitionByRange(ranges, "curve_key", "tie").sortWithinPartitions("curve_key", "tie")
    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)
