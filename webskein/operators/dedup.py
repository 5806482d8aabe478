"""Duplicates by arrival order: exact by content hash, near by SimHash distance to what was unique before.

A document is unique if no earlier unique one is within DISTANCE bits. That isn't a connected component: what is near a
duplicate only is unique. Candidates come from an exact split of the fingerprint: of b blocks, nine differing bits leave
b - 9 equal at least, so fingerprints are joined on every choice of b - 9 blocks. More blocks make longer keys, which
meet by chance less often, but more of them; b is what costs least for the number of fingerprints. It changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..session import checkpointed, spread

#: Similarity of 0.85 of 64 bits.
DISTANCE = 9
SHORT = 50
#: Least and largest number of blocks that a fingerprint is cut into.
LEAST_BLOCKS, MOST_BLOCKS = 10, 14
#: Fingerprints that a part has on average at most (32 MB), the least number of parts, and pairs that are compared at once.
PART, PARTS, PAIRS_AT_ONCE = 4_000_000, 64, 1 << 20


def blocks_for(n: int) -> int:
    """The number of blocks that gives n fingerprints the fewest keys and chance candidates together."""

    def cost(b: int) -> float:
        bits = 64 * (b - DISTANCE) / b
        return comb(b, DISTANCE) * (n + n * n / 2 ** (bits + 1))

    return min(range(LEAST_BLOCKS, MOST_BLOCKS + 1), key=cost)


def masks(blocks: int) -> list[int]:
    """Signed 64-bit masks of every choice of blocks - DISTANCE blocks, in lexicographic order."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    sums = (sum(chosen) for chosen in combinations(each, blocks - DISTANCE))
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser on uint64: the remainder of what it gives depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _met(prints: np.ndarray, mask: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the distinct prints (unsigned) that are equal under the mask and differ in at most `most` bits, so many at once."""
    value = prints & np.uint64(mask)
    order = np.argsort(value, kind="stable")
    value, prints = value[order], prints[order]
    edge = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    ends = np.repeat(np.append(edge[1:], len(value)), np.diff(np.append(edge, len(value))))
    others = ends - np.arange(len(value)) - 1  # prints after each one in its run
    at = np.flatnonzero(others)
    sums = np.cumsum(others[at])
    k = 0
    while k < len(at):
        # a print that has more others than fit is taken alone, in steps
        end = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + PAIRS_AT_ONCE, side="right")))
        own, k = at[k:end], end
        count = others[own]
        for first in range(0, int(count.max()), PAIRS_AT_ONCE):
            left = np.clip(count - first, 0, PAIRS_AT_ONCE)
            x = np.repeat(own, left)
            y = x + 1 + first + np.arange(len(x)) - np.repeat(np.cumsum(left) - left, left)
            near = np.bitwise_count(prints[x] ^ prints[y]) <= most
            yield prints[x[near]], prints[y[near]]


def near_pairs(prints: DataFrame, most: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """fp_a, fp_b, distance of the distinct fingerprints (column fp) within `most` bits, fp_a < fp_b; exact for most <= 9.

    The fingerprints are dealt out as arrays: a part has all of them for some choices of blocks or, beyond PART, those of
    one choice whose blocks have one remainder. Parts are sorted and compared where they are, so no key becomes a row and
    nothing is broadcast. A pair that meets under several keys is given under the first of them only, so nothing is made
    distinct afterwards.
    """
    if most > DISTANCE:
        raise ValueError(f"the blocks find all pairs within {DISTANCE} bits only")
    distinct = checkpointed(prints.select("fp").distinct()).filter("fp IS NOT NULL")  # a filter before would compute fingerprints twice
    n = distinct.count()
    chosen = [m % (1 << 64) for m in masks(blocks or blocks_for(n))]
    shares = -(-n // PART)  # parts of a choice
    together = 1 if shares > 1 else -(-len(chosen) // min(len(chosen), max(PARTS, 4 * prints.sparkSession.sparkContext.defaultParallelism)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for first in range(0, len(chosen), together):
                if shares > 1:
                    share = (_mixed(fp & np.uint64(chosen[first])) % np.uint64(shares)).astype(np.int64)
                    parts = [(k, fp[share == k]) for k in np.unique(share).tolist()]
                else:
                    parts = [(0, fp)]
                yield pa.RecordBatch.from_arrays([pa.array([first] * len(parts), pa.int32()), pa.array([k for k, _ in parts], pa.int64()), pa.array([p.tobytes() for _, p in parts], pa.binary())], ["choice", "share", "prints"])

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = np.concatenate([np.frombuffer(x, dtype=np.uint64) for b in batches for x in b.column("prints").to_pylist()])
        before = chosen[: key[0].as_py()]
        for mask in chosen[len(before) : len(before) + together]:
            for x, y in _met(fp, mask, most):
                for earlier in before:
                    if not len(x):
                        break
                    new = (x ^ y) & np.uint64(earlier) != 0
                    x, y = x[new], y[new]
                x, y = x.view(np.int64), y.view(np.int64)
                near = np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int32)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(near)], ["fp_a", "fp_b", "distance"])
            before.append(mask)

    dealt = distinct.select("fp").mapInArrow(deal, "choice int, share bigint, prints binary")
    return dealt.groupBy("choice", "share").applyInArrow(compare, "fp_a bigint, fp_b bigint, distance int")


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fp and unique of every node (fp, seq): unique where no earlier unique node is joined to it by an edge (fp_a, fp_b)."""
    seq = nodes.select("fp", "seq")
    both = edges.select(F.col("fp_a").alias("x"), F.col("fp_b").alias("y")).unionByName(edges.select(F.col("fp_b").alias("x"), F.col("fp_a").alias("y")))
    # sizes after a checkpoint are guesses by its plan, so what grows with the table is never broadcast by them
    earlier = both.join(seq.withColumnsRenamed({"fp": "x", "seq": "sx"}).hint("merge"), "x").join(seq.withColumnsRenamed({"fp": "y", "seq": "sy"}).hint("merge"), "y").filter("sx < sy").select("x", "y")
    earlier = checkpointed(earlier)
    done = checkpointed(nodes.join(earlier.select(F.col("y").alias("fp")).distinct().hint("merge"), "fp", "left_anti").select("fp", F.lit(True).alias("unique")))
    rest = checkpointed(earlier.select(F.col("y").alias("fp")).distinct())
    while rest.head(1):
        known = earlier.join(rest.hint("merge"), F.col("y") == F.col("fp"), "left_semi").join(done.withColumnRenamed("fp", "x").hint("merge"), "x", "left")
        state = known.groupBy("y").agg(F.coalesce(F.bool_or("unique"), F.lit(False)).alias("near"), F.bool_and(F.col("unique").isNotNull()).alias("all"))
        step = checkpointed(state.filter("near or all").select(F.col("y").alias("fp"), (~F.col("near")).alias("unique")))
        done = checkpointed(done.unionByName(step))
        rest = checkpointed(rest.join(step.hint("merge"), "fp", "left_anti"))
    return done


def deduplicated(docs: DataFrame, key: str = "doc_id", content: str = "text", most: int = DISTANCE) -> DataFrame:
    """id, is_duplicate, similarity, matching_id and method of every document; ids give the order of arrival."""
    base = spread(docs.select(F.col(key).alias("id"), F.coalesce(F.col(content), F.lit("")).alias("text")))
    long = F.length(text.strip(F.col("text"))) >= SHORT
    given = checkpointed(base.filter(long).select("id", hashing.content_hash(F.col("text")).alias("hash"), hashing.simhash("text").alias("fp")))
    nodes = checkpointed(given.groupBy("fp").agg(F.min("id").alias("seq")))
    edges = checkpointed(near_pairs(nodes, most))
    kept = leaders(nodes, edges).filter("unique").join(nodes.hint("merge"), "fp").join(given.select(F.col("id").alias("seq"), "hash").hint("merge"), "seq").select("fp", F.col("seq").alias("leader"), "hash")
    own = nodes.select("fp", F.col("fp").alias("other"), F.lit(0).alias("distance"))
    sides = [edges.select(F.col(a).alias("fp"), F.col(b).alias("other"), "distance") for a, b in (("fp_a", "fp_b"), ("fp_b", "fp_a"))]
    near = own.unionByName(sides[0]).unionByName(sides[1]).join(kept.withColumnRenamed("fp", "other").hint("merge"), "other").select("fp", "leader", "distance")
    by_hash = kept.groupBy("hash").agg(F.min("leader").alias("same"))
    joined = given.join(near.hint("merge"), "fp").filter("leader <= id").groupBy("id", "hash").agg(F.min(F.struct("distance", "leader")).alias("best"))
    joined = joined.join(by_hash.hint("merge"), "hash", "left")
    is_leader = F.col("best.leader") == F.col("id")
    exact = F.col("same").isNotNull() & (F.col("same") < F.col("id"))
    long_rows = joined.select(
        "id",
        (~is_leader).alias("is_duplicate"),
        F.when(is_leader, 0.0).when(exact, 1.0).otherwise(1 - F.col("best.distance") / 64).alias("similarity"),
        F.when(~is_leader, F.when(exact, F.col("same")).otherwise(F.col("best.leader"))).alias("matching_id"),
        F.when(is_leader, "unique").when(exact, "exact_hash").otherwise("simhash").alias("method"),
    )
    short_rows = base.filter(~long).select("id", F.lit(False).alias("is_duplicate"), F.lit(0.0).alias("similarity"), F.lit(None).cast(dict(docs.dtypes)[key]).alias("matching_id"), F.lit("skipped_short_content").alias("method"))
    return long_rows.unionByName(short_rows)


def stats(result: DataFrame) -> DataFrame:
    """unique_documents, duplicates_found and threshold."""
    return result.agg(F.count_if(F.col("method") == "unique").alias("unique_documents"), F.count_if("is_duplicate").alias("duplicates_found"), F.lit(0.85).alias("threshold"))


def duplicate_count(result: DataFrame) -> DataFrame:
    return result.agg(F.count_if("is_duplicate").alias("duplicates"))
