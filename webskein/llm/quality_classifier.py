"""A compression classifier: zstandard dictionaries of good and of bad labelled text.

A text is compressed, block by block and whole, once with each dictionary. The normalised difference of the two sizes,
with the sizes per byte, goes through a logistic curve that is fitted on labelled rows which the dictionaries haven't
seen. The fit reads a bounded sample of labelled rows (DICTIONARY_ROWS for each class, CALIBRATION_ROWS more for both,
texts of at most SAMPLE_CHARS characters, SAMPLE_BYTES of each class in all); scoring reads every row and the whole text.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out and never learnt from; labels, language, source and ids are no
inputs of a score. Null texts count as empty. Empty texts have a score too; equal texts have equal scores. Labels that
are null, contradict each other or have no document aren't used; where a class has no row at all, every score is 0.5.
Every input row gives one row. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, slices, written

DICTIONARY_ROWS = 3000
CALIBRATION_ROWS = 4000
SAMPLE_CHARS = 20_000
SAMPLE_BYTES = 24 << 20
DICTIONARY_BYTES = 112_640
BLOCK = 4096
LEVEL = 3
THRESHOLD = 0.7
SHARED_LINE = 3


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts' own bytes where they are too few to train one."""
    samples = [b for t in texts for b in _blocks(t) if b]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


def without_shared_lines(*classes: list[bytes]) -> list[list[bytes]]:
    """The texts without lines that SHARED_LINE of them or more have: such lines tell no class, whichever dictionary had more of them."""
    count = Counter(line for texts in classes for t in texts for line in set(t.split(b"\n")))
    return [[b"\n".join(line for line in t.split(b"\n") if count[line] < SHARED_LINE) or t for t in texts] for texts in classes]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Sizes:
    """Features of a text from its sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def features(self, data: bytes) -> list[float]:
        g = b = 0
        for block in _blocks(data):
            g += len(self.good.compress(block))
            b += len(self.bad.compress(block))
        n = len(data) + 32
        d = (b - g) / (b + g)
        length = np.log(n) - 7
        return [d, g / n, b / n, length, d * length, abs(d), d * g / n, (g / n) ** 2]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def fit(good: list[bytes], bad: list[bytes], known: list[tuple[bytes, int]]) -> Model | None:
    """Dictionaries of the first two, and the curve fitted on the third."""
    if not good or not bad:
        return None
    good, bad = without_shared_lines(good, bad)
    d = dictionary(good), dictionary(bad)
    sizes = Sizes(*d)
    known = known if len({y for _, y in known}) == 2 else [(t, 1) for t in good] + [(t, 0) for t in bad]
    x, y = np.array([sizes.features(t) for t, _ in known]), np.array([y for _, y in known], dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)]
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-3, *[0.05] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-6)) @ z + penalty, z.T @ (y - p) - penalty @ w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 4 / max(size, 1e-9))
        if size < 1e-8:
            break
    return Model(*d, mean, scale, w)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of a bounded sample of labelled rows that aren't held out, chosen by a hash of their ids."""
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    one = one.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").filter(~held_out())
    most = DICTIONARY_ROWS + CALIBRATION_ROWS
    chosen = [one.filter(F.col("quality") == q).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    ids = [(r.doc_id, r.quality) for c in chosen for r in c.collect()]  # at most 2 * most rows
    if not ids:
        return None
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(ids, "id bigint, quality int"))  # bounded by `most`
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    found, folder = written(text.join(small, F.col("doc_id") == F.col("id")).groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled")
    place = {i: k for k, (i, _) in enumerate(ids)}
    sizes = sorted(((place[r.doc_id], r.doc_id, r.quality, r.size) for r in found.select("doc_id", "quality", F.octet_length("text").alias("size")).collect()))
    used, taken = [0, 0], []
    for _, i, q, size in sizes:
        if used[q] + size <= SAMPLE_BYTES:
            used[q] += size
            taken.append((i,))
    wanted = F.broadcast(spark.createDataFrame(taken, "doc_id bigint"))
    rows = sorted(((place[r.doc_id], r.quality, r.text.encode()) for r in found.join(wanted, "doc_id").toLocalIterator()), key=lambda r: r[0])
    delete(spark, folder)
    by = {q: list(dict.fromkeys(t for _, y, t in rows if y == q)) for q in (0, 1)}
    # the dictionaries take two thirds of a class at most, so that rows are left for the curve
    cut = {q: min(DICTIONARY_ROWS, -(-2 * len(v) // 3)) for q, v in by.items()}
    share = {q: [(t, q) for t in v[cut[q] :]] for q, v in by.items()}
    total = max(1, sum(map(len, share.values())))
    known = [x for v in share.values() for x in v[: max(1, CALIBRATION_ROWS * len(v) // total)]]
    return fit(by[1][: cut[1]], by[0][: cut[0]], known)


def score(docs: DataFrame, model: Model | None, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `score`, of every row."""
    names = [k for k in keep if k != "score"]
    read = docs.select(*names, *([] if "text" in names else [F.col("text").cast("string").alias("text")]))
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        sizes = Sizes(m.good, m.bad) if m else None
        for b in slices(batches):
            given = [t or "" for t in b.column("text").to_pylist()]
            if sizes:
                distinct = {t: k for k, t in enumerate(dict.fromkeys(given))}
                s = m.scores(np.array([sizes.features(t.encode()) for t in distinct]))
                scores = [float(s[distinct[t]]) for t in given]
            else:
                scores = [0.5] * len(given)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(scores, pa.float64())], [*names, "score"])

    types = dict(read.dtypes)
    return read.mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in names), "score double"]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents."""
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(read, learn(read, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
