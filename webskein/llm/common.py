"""Shared parts: the shared folder, written tables, and words and hashes of Arrow columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpointed, shared_folder, sliced  # noqa: F401

#: Bytes of text that the vectorised passes hold at once (a longer document is cut between words).
CHUNK = 1 << 20
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a group from which on its memory is given back after it.
GIVE_BACK = 4 << 20
#: What drops the caches that operators keep in a worker from task to task.
caches: list[Callable[[], None]] = []


def give_back(size: int = GIVE_BACK, cached: bool = False) -> None:
    """Give memory that is free to the system, after a group of `size` bytes or a task: a worker runs tasks of one stage
    after another and else keeps what the largest needed. With cached=True first drop the caches of all operators."""
    if cached:
        for drop in caches:
            drop()
        gc.collect()
    if size >= GIVE_BACK:
        pa.default_memory_pool().release_unused()
        if _TRIM:
            _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than glibc
    _TRIM = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends, or before by delete()."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_late_delete, spark, path)
    return path


def _late_delete(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended first
        shutil.rmtree(re.sub(r"^file:(//)?", "", path), ignore_errors=True)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files, from the file system's summary."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_table(ranges: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """A table of the 256 bytes: True where the byte is in none of the ranges."""
    t = np.ones(256, dtype=bool)
    for low, high in ranges:
        t[low : high + 1] = False
    return t


#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACED = byte_table(ranges=((0x20, 0x20), (0x09, 0x0D)))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows with at most about `most` bytes of text in their column 'text', or of one row."""
    return sliced(batches, "text", most)


def grouped(docs: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together, or of one document."""
    first = size = 0
    for i, d in enumerate(docs):
        if i > first and size + len(d) > most:
            yield first, i
            first, size = i, 0
        size += len(d) + 1
    if first < len(docs):
        yield first, len(docs)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser on uint64: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 4096)
            for name, base in (("up", BASE), ("down", INVERSE)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a))
        return cls.up[:n], cls.down[:n]


def _hash_piece(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = word[data]
    edges = np.diff(w.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    up, down = _Powers.to(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word (run of word bytes) of a byte array, in bounded memory."""
    n, at, out = len(data), 0, []
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            gaps = np.flatnonzero(~word[data[at:to]])
            while not len(gaps) and to < n:  # one word longer than the chunk
                to = min(n, to + CHUNK)
                gaps = np.flatnonzero(~word[data[at:to]])
            if to < n or len(gaps) and n - at > CHUNK:
                to = at + int(gaps[-1]) + 1
        s, h = _hash_piece(data[at:to], word)
        out.append((s + at, h))
        at = to
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate([s for s, _ in out]), np.concatenate([h for _, h in out])


def document_words(docs: list[bytes], word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents in order, and where each document's words begin (one more entry at the end)."""
    data = np.frombuffer(b"\n".join(docs), dtype=np.uint8)
    if lower:
        data = LOWER[data]
    starts, hashes = word_hashes(data, word)
    at = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=at[1:])
    return hashes, np.searchsorted(starts, at)
