"""Content hashes, SimHash fingerprints and their distances."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 64
_TOKENS = re.compile(r"\w+")
_SPACE = "(?U)\\s"


def content_hash(text: Column) -> Column:
    """SHA-256 of the text trimmed, lower-cased, with single spaces."""
    bare = F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")
    return F.sha2(F.regexp_replace(F.lower(bare), f"{_SPACE}+", " "), 256)


def raw_hash(text: Column) -> Column:
    """MD5 of the text as it is; "" for the empty text."""
    return F.when(text == "", F.lit("")).otherwise(F.md5(text))


@lru_cache(maxsize=200_000)
def _feature(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[8:], "big")


def _vote(hashes: list[int], weights: np.ndarray | None = None) -> int:
    """A bit is set where more weight is for it than against it."""
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    votes = (2 * bits - 1).T @ (np.ones(len(hashes), dtype=np.int64) if weights is None else weights)
    return int(np.packbits(votes > 0).view(">u8")[0].astype(np.int64))


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of the word shingles, as a signed number; a text without words is one empty shingle."""
    w = _TOKENS.findall(text.lower())
    return _vote([_feature(" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))])


def character_fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash of character n-grams weighted by their counts; 0 for the empty text."""
    if not text:
        return 0
    joined = "".join(_TOKENS.findall(text.lower()))
    grams = pd.Series([joined[i : i + width] for i in range(max(1, len(joined) - width + 1))]).value_counts()
    return _vote([_feature(g) for g in grams.index], grams.to_numpy(dtype=np.int64))


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fingerprint(t or ""))


@F.pandas_udf(T.LongType())
def character_simhash(text: pd.Series) -> pd.Series:
    return text.map(lambda t: character_fingerprint(t or ""))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - hamming(a, b) / BITS


def is_near(a: Column, b: Column, most: int = 3) -> Column:
    """Whether two non-zero fingerprints differ in at most `most` bits."""
    return (a != 0) & (b != 0) & (hamming(a, b) <= most)


def similarity_score(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), 0.0).otherwise(similarity(a, b))


def fingerprints(pages: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """url, simhash of character n-grams, raw content hash and length."""
    t = F.coalesce(F.col(text), F.lit(""))
    return pages.select(F.col(url).alias("url"), character_simhash(t).alias("simhash"), raw_hash(t).alias("content_hash"), F.length(t).alias("text_length"))


def compared(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs of fingerprints (columns a and b) with similarity, url_similarity, exact_match and is_duplicate."""
    from . import urls

    score = similarity_score(F.col("a.simhash"), F.col("b.simhash"))
    exact = (F.col("a.content_hash") == F.col("b.content_hash")) & (F.col("a.content_hash") != "")
    return pairs.select(F.col("a.url").alias("url_a"), F.col("b.url").alias("url_b"), score.alias("similarity"), exact.alias("exact_match"), ((score >= threshold) | exact).alias("is_duplicate"), urls.similarity(F.col("a.url"), F.col("b.url")).alias("url_similarity"))
