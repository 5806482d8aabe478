"""Near-duplicate join of word n-gram sets by token-combination prefixes, and its connected components.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets are one node; only different
nodes are joined. Two sets with 100 * intersection >= PERCENT * union differ in few tokens, so each set may lose at
most its slack of tokens. Tokens are ordered by class (rare before frequent) and then by hash. A prefix of that order is
extended until losing the slack still leaves, in some class, k tokens that both sets then have in their prefixes:
classes of rare tokens are indexed token by token (k = 1), frequent classes by pairs or triples of tokens (k = 2, 3),
which are formed within sub-classes so that their number stays in proportion to the set. Sets are compared within
bands of size; one near a band's lower end is indexed in the band below as well. Nodes that share an index entry are
candidates and are verified on their whole sets; none is left out. First each node is verified with the smallest node
under each of its entries and with its neighbours by size; candidates that are connected by then need no further check,
all others get one. Pairs are verified in blocks of nodes of one family: a pair of blocks is one row, with the nodes of
either side, and all of these are compared at once by a product of matrices, so that large families need neither a row
nor a copy of the texts nor a step of Python for each pair. The links that result connect whatever is linked; with connecting=False every linked
pair of nodes is given, and `link_counts` has each document's number of links.

A node is known by a 64-bit digest of its set; a second digest of each set is compared as well, and where two sets share
the first, both go by the second (so identity has 128 bits). Which digests are shared is found by an aggregation; at
10**10 sets about three are expected.

The class of a token only steers the cost: whichever tokens count as frequent, all links are found. That set is broadcast
and has at most FREQUENT_TOKENS members (16 MB; the count from which a token is frequent rises until it fits).

Null or wordless texts have empty sets and are linked with nothing. Texts with fewer words than a shingle have the whole
word sequence as their only shingle. Rows with a null doc_id aren't linked and get a null component. Rows that repeat a
doc_id are linked by it. Columns of other names aren't read. Shingles are compared by 64-bit hashes. An empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, checkpointed, delete, document_words, give_back, grouped, mix, slices, texts, written

WORDS = 4
PERCENT = 85
#: Counts over which a token belongs to the classes of pairs and of triples.
FREQUENT, VERY_FREQUENT = 8, 512
FREQUENT_TOKENS = 2_000_000
#: A band's number of sub-classes is its lower size divided by this.
SUBCLASS = 16
#: Bands below this size index single tokens only.
SMALL = 32
#: Bytes of text that a task gathers before it hands on its index entries.
FLUSH = 8 << 20
#: Rows of wanted texts (ids and blocks, about 64 bytes each when broadcast) up to which they are broadcast to the scan of the documents: 16 MB.
BROADCAST_ROWS = 1 << 18
#: Parts that the rows of a hot family, and the copies of one set, are dealt to.
SALTS, COPY_SALTS = 64, 8
#: Nodes of one family that lie in one block, and shingles of them.
BLOCK_NODES, BLOCK_SHINGLES = 256, 1_000_000
#: Blocks of a family from which on they grow, to LARGE_BLOCK_NODES: a text is read once for each pair of its block.
MANY_BLOCKS, LARGE_BLOCK_NODES = 24, 2048
#: Two blocks are compared whole if one signature has at least this part of the nodes of each.
WHOLE_SHARE = 8
#: The third side of a pair of blocks: all nodes of both.
WHOLE = 2
#: Shingles and index entries that a bucket has on average.
BUCKET_TOKENS = 2_000_000
#: Pairs that are counted at once where sets are compared pair by pair.
PAIRS_AT_ONCE = 500_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], dtype=np.uint64)

_ALL = (1 << 64) - 1


def shingle_sets(docs: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in grouped(docs):
        h, at = document_words(docs[a:b], SPACED, lower=True)
        wide = max(0, len(h) - words + 1)
        s = np.zeros(wide, dtype=np.uint64)
        for k in range(words):
            s += h[k : k + wide] * _MULTIPLIERS[k % 8] + np.uint64(k // 8)
        s = mix(s)
        for i in range(b - a):
            first, end = at[i], at[i + 1]
            if end - first >= words:
                own = np.sort(s[first : end - words + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif end > first:
                own = np.uint64(end - first) + (h[first:end] * _MULTIPLIERS[: end - first]).sum(dtype=np.uint64)
                yield mix(np.array([own], dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield np.empty(0, dtype=np.uint64)


def digests(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set; equal sets, equal digests."""
    first, second = (int((mix(tokens ^ np.uint64(k)).sum(dtype=np.uint64) ^ np.uint64(len(tokens))).astype(np.int64)) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
    return first, second


def node_of(tokens: np.ndarray, shared: frozenset[int]) -> int:
    """The node of a set: its first digest, or its second where different sets share the first."""
    first, second = digests(tokens)
    return second if first in shared else first


def slack(n: int, percent: int) -> int:
    """Tokens of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


@functools.cache
def _choices(m: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(m), k)), dtype=np.int64).reshape(-1, k)


def signatures(tokens: np.ndarray, kind: np.ndarray, percent: int) -> np.ndarray:
    """The index entries of a set (sorted tokens and their class 1, 2 or 3) over all its bands."""
    n = len(tokens)
    need = slack(n, percent) + 1
    top = n.bit_length() - 1
    bands = [top] if top == 0 or -(-percent * n // 100) >= 1 << top else [top, top - 1]
    order = np.argsort(kind, kind="stable") if kind.any() else None
    t = tokens if order is None else tokens[order]
    c = np.ones(n, dtype=np.int64) if order is None else kind[order] + 1
    out = []
    for band in bands:
        salt = np.uint64(int(_MULTIPLIERS[5]) * (band + 1) & _ALL)
        single = n if 1 << band < SMALL else int(np.searchsorted(c, 2))
        out.append(mix(t[: min(need, single)] + salt))
        if single >= need:
            continue
        rest, k = t[single:], c[single:]
        # the sub-class of each token, numbered through the classes
        sub = (rest % np.uint64(max(1, (1 << band) // SUBCLASS))).astype(np.int64) * 4 + k
        by = np.argsort(sub, kind="stable")
        edge = np.flatnonzero(np.diff(sub[by], prepend=-1))
        rank = np.empty(len(sub), dtype=np.int64)
        rank[by] = np.arange(len(sub)) - np.repeat(edge, np.diff(np.append(edge, len(sub))))
        gained = np.cumsum(rank >= k - 1)
        used = int(np.searchsorted(gained, need - single)) + 1  # the prefix ends where enough is gained
        kept = by[by < used]
        groups = sub[kept]
        edge = np.append(np.flatnonzero(np.diff(groups, prepend=-1)), len(kept))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            size = int(groups[a] % 4)
            if b - a >= size:
                members = rest[kept[a:b]][_choices(int(b - a), size)]
                out.append(mix((members * _MULTIPLIERS[:size]).sum(axis=1, dtype=np.uint64) + (salt ^ np.uint64(size))))
    return np.concatenate(out)


def _bucket_bits(df: DataFrame, shingles: int) -> int:
    """Bits of the bucket number: eight buckets a shuffle partition at least, and as many as keep a bucket's shingles bounded on average."""
    return min(32, max(6, math.ceil(math.log2(max(8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles / BUCKET_TOKENS)))))


def _split(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted values lie in, and their edges."""
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[edge], np.append(edge, len(values))


def _low(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(32 - bits)).astype(np.uint32)


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def nodes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (the set's size), and both digests of the set, node and second (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(cached=True)
        for b in slices(batches):
            found = [(len(s), *(digests(s) if len(s) else (None, None))) for s in shingle_sets(texts(b.column("text")), words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], ["doc_id", "n", "node", "second"])
        give_back()

    return _rows(docs).mapInArrow(run, "doc_id bigint, n bigint, node bigint, second bigint")


def shared_digests(members: DataFrame) -> frozenset[int]:
    """First digests that different sets share: none is expected below 10**9 sets, three at 10**10."""
    found = members.filter("node is not null").groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("z")).filter("a != z")
    return frozenset(r.node for r in found.select("node").collect())


def _distinct_sets(batches: Iterator[pa.RecordBatch], words: int, shared: frozenset[int]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Non-empty distinct sets with their nodes, gathered from about FLUSH bytes of text each."""
    seen: set[int] = set()
    out: list[tuple[int, np.ndarray]] = []
    size = 0
    for b in slices(batches):
        docs = texts(b.column("text"))
        for d, s in zip(docs, shingle_sets(docs, words), strict=True):
            if len(s) and (node := node_of(s, shared)) not in seen:
                seen.add(node)
                out.append((node, s))
                size += len(d)
                if size >= FLUSH:
                    yield out
                    seen, out, size = set(), [], 0
    if out:
        yield out


def frequent_tokens(docs: DataFrame, words: int, frequent: int, bits: int) -> DataFrame:
    """token (its top bits) and count of every token that more than `frequent` sets have, counted over all documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(cached=True)
        for sets in _distinct_sets(batches, words, frozenset()):
            values, counts = np.unique(np.concatenate([s for _, s in sets]), return_counts=True)
            sets.clear()
            bucket, edge = _split(values, bits)
            low, more = _low(values, bits), np.flatnonzero(counts > 1)
            cut = np.searchsorted(more, edge)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket, pa.int64()),
                    pa.array([low[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                    pa.array([low[more[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([(counts[more[a:b]] - 1).astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                ["bucket", "tokens", "again", "extra"],
            )
        give_back()

    def count(key: tuple, t: pa.Table) -> pa.Table:
        read = lambda c: np.concatenate([np.frombuffer(x, dtype="<u4") for x in t.column(c).to_pylist()])
        one, again, extra = read("tokens"), read("again"), read("extra")
        values, counts = np.unique(one, return_counts=True)
        np.add.at(counts, np.searchsorted(values, again), extra)
        few = counts > frequent
        give_back(t.nbytes)
        return pa.table({"token": pa.array((key[0].as_py() << 32) + values[few].astype(np.int64), pa.int64()), "count": pa.array(counts[few], pa.int64())})

    return _rows(docs).filter("doc_id is not null").mapInArrow(emit, "bucket bigint, tokens binary, again binary, extra binary").groupBy("bucket").applyInArrow(count, "token bigint, count bigint")


class Classes:
    """Looks up the class of tokens: 0 for rare ones, 1 or 2 for frequent ones."""

    BITS = 24

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, bits: int, very: int):
        order = np.argsort(tokens)
        self.tokens, self.kind, self.bits = tokens[order].astype(np.uint64), 1 + (counts[order] > very).astype(np.int8), bits
        self.known = np.zeros(1 << self.BITS, dtype=bool)
        self.known[(self.tokens & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), dtype=np.int8)
        if len(self.tokens):
            top = tokens >> np.uint64(32 - self.bits)
            maybe = np.flatnonzero(self.known[(top & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.tokens, top[maybe]), len(self.tokens) - 1)
            out[maybe] = np.where(self.tokens[at] == top[maybe], self.kind[at], 0)
        return out


def entries(docs: DataFrame, held, bits: int, words: int, percent: int, shared_: frozenset[int]) -> DataFrame:
    """The index entries that two or more nodes share: signature, node, n, and pivot (the entry's smallest node). held: a broadcast of the classes' tokens and kinds."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(cached=True)
        tokens, kind = held.value
        look = Classes(tokens, np.zeros(len(tokens)), bits, 0)
        look.kind = kind
        for sets in _distinct_sets(batches, words, shared_):
            found = [signatures(s, look.of(s), percent) for _, s in sets]
            names, sizes = np.array([n for n, _ in sets], dtype=np.int64), np.array([len(s) for _, s in sets], dtype=np.uint32)
            sets.clear()
            owner = np.repeat(np.arange(len(names), dtype=np.int32), [len(f) for f in found])
            values = np.concatenate(found)
            del found
            order = np.argsort(values)
            values, owner = values[order], owner[order]
            del order
            node, n = names[owner], sizes[owner]
            bucket, edge = _split(values, bits)
            low = _low(values, bits)
            parts = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), parts(low), parts(node), parts(n)], ["bucket", "low", "node", "n"])
            del values, owner, node, n, low
        give_back()

    def shared(key: tuple, t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in t.column(c).to_pylist()])
        low, node, n = read("low", "<u4"), read("node", "<i8"), read("n", "<u4")
        order = np.lexsort((node, low))
        low, node, n = low[order], node[order], n[order]
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
        low, node, n = low[new], node[new], n[new]
        edge = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        size = np.diff(np.append(edge, len(low)))
        pivot, many = np.repeat(node[edge], size), np.repeat(size, size) > 1
        give_back(t.nbytes)
        return pa.table({"signature": pa.array((key[0].as_py() << 32) + low[many].astype(np.int64), pa.int64()), "node": pa.array(node[many], pa.int64()), "n": pa.array(n[many].astype(np.int64), pa.int64()), "pivot": pa.array(pivot[many], pa.int64())})

    return _rows(docs).filter("doc_id is not null").mapInArrow(emit, "bucket bigint, low binary, node binary, n binary").groupBy("bucket").applyInArrow(shared, "signature bigint, node bigint, n bigint, pivot bigint")


def blocked(live: DataFrame) -> DataFrame:
    """The entries (signature, node, n) with the node's block, and the nodes that a block of its family has (0 where the family is one block).

    Nodes with the same smallest partner lie in the same block, or in several where they are many or large.
    """
    known = live.groupBy("node").agg(F.min("pivot").alias("pivot"), F.first("n").alias("n")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS).cast("bigint")))
    many = F.greatest(F.least(F.count("*") / BLOCK_NODES, F.lit(MANY_BLOCKS).cast("double")), F.count("*") / LARGE_BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)
    count = known.groupBy("pivot").agg(F.ceil(many).alias("blocks"), F.count("*").alias("nodes")).withColumn("size", F.ceil(F.col("nodes") / F.col("blocks")))
    # only families of several blocks are looked up, by salt, so that a family's rows aren't brought together
    large = count.filter("blocks > 1").select("pivot", "blocks", "size").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    block = F.xxhash64("pivot", F.pmod(F.xxhash64(F.lit("block"), "node"), F.coalesce("blocks", F.lit(1).cast("bigint"))))
    placed = known.join(large, ["pivot", "salt"], "left").select("node", block.alias("block"), F.coalesce("size", F.lit(0).cast("bigint")).alias("size"))
    return live.select("signature", "node", "n").join(placed, "node")


def _pairs(signature: np.ndarray, node: np.ndarray, n: np.ndarray, part: np.ndarray, percent: int, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in different parts under equal signatures (rows sorted by signature and n) that lie at most `near` rows apart."""
    for d in range(1, near + 1):
        at = np.flatnonzero((signature[d:] == signature[:-d]) & (part[d:] != part[:-d]) & (100 * n[:-d] >= percent * n[d:]))
        if len(at):
            yield at, at + d


def _least_pairs(signature: np.ndarray, node: np.ndarray, n: np.ndarray, part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each signature's smallest node and of the others."""
    edge = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
    size = np.diff(np.append(edge, len(signature)))
    least = np.flatnonzero(node == np.repeat(np.minimum.reduceat(node, edge), size))  # one a signature: its nodes are distinct
    least = np.repeat(least, size)
    at = np.flatnonzero((part != part[least]) & (100 * np.minimum(n, n[least]) >= percent * np.maximum(n, n[least])))
    return least[at], at


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range of so many."""
    return np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)


def _meetings(node: np.ndarray, n: np.ndarray, part: np.ndarray, block: np.ndarray, size: np.ndarray, percent: int) -> Iterator[list[np.ndarray]]:
    """The pairs of blocks that meet under one signature, as rows (ba, bb, node, side): the nodes of either side, or one row of side WHOLE where the signature has much of both blocks."""
    order = np.argsort(block, kind="stable")
    node, n, part, block, size = (x[order] for x in (node, n, part, block, size))
    at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    count = np.diff(np.append(at, len(block)))
    names, much = block[at], (size[at] > 0) & (WHOLE_SHARE * count >= size[at])
    low, high, least, most = np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.minimum.reduceat(part, at), np.maximum.reduceat(part, at)
    rows = max(1, 1_000_000 // len(node))
    for first in range(0, len(at), rows):
        i = np.arange(first, min(first + rows, len(at)))
        i, j = np.repeat(i, len(at) - i), _spread(i, len(at) - i)
        one = (least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j])
        kept = ~one & (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        i, j = i[kept], j[kept]
        whole = much[i] & much[j]
        if whole.any():
            yield [names[i[whole]], names[j[whole]], np.zeros(int(whole.sum()), dtype=np.int64), np.full(int(whole.sum()), WHOLE)]
        i, j = i[~whole], j[~whole]
        if len(i):
            for side, x in enumerate((i, j)):
                yield [np.repeat(names[i], count[x]), np.repeat(names[j], count[x]), node[_spread(at[x], count[x])], np.full(int(count[x].sum()), side)]


def _candidates(signature: np.ndarray, node: np.ndarray, n: np.ndarray, part: np.ndarray, block: np.ndarray, size: np.ndarray, percent: int, every: bool) -> Iterator[list[np.ndarray]]:
    """Rows (ba, bb, node, side) of the nodes that meet under equal signatures (rows sorted by signature and n): of neighbours and each signature's smallest node, or of all that aren't in one part."""
    near = 8 if every else 1
    large = np.empty(0, dtype=np.int64)
    if every:
        edge = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
        count = np.diff(np.append(edge, len(signature)))
        mixed = np.minimum.reduceat(part, edge) != np.maximum.reduceat(part, edge)
        large = np.flatnonzero((count > near + 1) & mixed)
        few = np.repeat((count <= near + 1) & mixed, count)
        few = [x[few] for x in (signature, node, n, part, block)]
        pairs = _pairs(*few[:4], percent, near)
    else:
        few = [signature, node, n, part, block]
        pairs = itertools.chain(_pairs(*few[:4], percent, near), [_least_pairs(*few[:4], percent)])
    for x, y in pairs:
        turned = few[4][x] > few[4][y]
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        for side, z in enumerate((x, y)):
            yield [few[4][x], few[4][y], few[1][z], np.full(len(z), side)]
    for g in large:
        own = slice(int(edge[g]), int(edge[g] + count[g]))
        yield from _meetings(node[own], n[own], part[own], block[own], size[own], percent)


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct rows (ba, bb, node, side), in order of block pair, side and node. The list given is used up."""
    ba, bb, node, side = rows
    order = np.lexsort((node, side, bb, ba))
    del ba, bb, node, side
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in range(len(rows)):  # one column after another, in place, as these are many rows
        rows[k] = rows[k][order]
        new[1:] |= rows[k][1:] != rows[k][:-1]
    del order
    for k in range(len(rows)):
        rows[k] = rows[k][new]
    return rows


def candidate_blocks(known: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of blocks with candidates in different parts, a row each: the first and second nodes, any two of which may be candidates, and all nodes; or whole, with no lists, where all nodes of both blocks are to be compared.

    known: signature, node, n, part, block, size. The nodes of a signature that many have are listed a side, not pair by pair.
    """
    names = ("signature", "node", "n", "part", "block", "size")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(cached=True)
        rest = [np.empty(0, dtype=np.int64)] * len(names)
        found: list[list[np.ndarray]] = []

        def distinct() -> list[np.ndarray]:
            columns = [[f[k] for f in found] for k in range(4)]
            found.clear()
            for k in range(4):  # the parts of a column go as soon as they are one
                columns[k] = np.concatenate(columns[k])
            rows = _distinct(columns)
            found.append(rows)
            return rows

        def batch() -> pa.RecordBatch:
            ba, bb, node, side = distinct()
            found.clear()
            edge = np.flatnonzero(np.concatenate(([True], (ba[1:] != ba[:-1]) | (bb[1:] != bb[:-1]))))
            left, right, whole = (np.add.reduceat(side == k, edge, dtype=np.int64) for k in (0, 1, WHOLE))
            part = lambda first, count: pa.array([b"" if w else node[i : i + k].tobytes() for i, k, w in zip(first, count, whole, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ba[edge], pa.int64()), pa.array(bb[edge], pa.int64()), part(edge, left), part(edge + left, right), pa.array(whole > 0)], ["ba", "bb", "a", "b", "whole"])

        size = 0
        for b in itertools.chain(batches, [None]):
            now = rest if b is None else [np.concatenate([r, b.column(c).to_numpy()]) for r, c in zip(rest, names, strict=True)]
            if not len(now[0]):
                continue
            whole = len(now[0]) if b is None else int(np.searchsorted(now[0], now[0][-1]))  # the last run may go on
            rest = [x[whole:] for x in now]
            if not whole:
                continue
            for rows in _candidates(*(x[:whole] for x in now), percent, every):
                if len(rows[0]):
                    found.append(rows)
                    size += len(rows[0])
                if size > 2_000_000:
                    size = len(distinct()[0])  # signatures of one family name the same nodes again and again
                    if size > 1_000_000:
                        yield batch()
                        size = 0
        if found:
            yield batch()
        give_back()

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        whole = any(t.column("whole").to_pylist())
        a, b = (np.unique(np.concatenate([np.frombuffer(b"" if whole else x, dtype="<i8") for x in t.column(c).to_pylist()])) for c in ("a", "b"))
        give_back(t.nbytes)
        return pa.table({"ba": pa.array([key[0].as_py()], pa.int64()), "bb": pa.array([key[1].as_py()], pa.int64()), "a": pa.array([a.tobytes()], pa.binary()), "b": pa.array([b.tobytes()], pa.binary()), "nodes": pa.array([np.union1d(a, b)], pa.list_(pa.int64())), "whole": pa.array([whole])})

    dealt = known.select(*names).repartition("signature").sortWithinPartitions("signature", "n")
    return dealt.mapInArrow(emit, "ba bigint, bb bigint, a binary, b binary, whole boolean").groupBy("ba", "bb").applyInArrow(merge, "ba bigint, bb bigint, a binary, b binary, nodes array<bigint>, whole boolean")


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of tokens that each set of `left` shares with each of `right`: tokens that many have by a product of matrices, others pair by pair."""
    out = np.zeros((len(left), len(right)), dtype=np.float64 if max(map(len, [*left, *right]), default=0) >= 1 << 24 else np.float32)  # exact to 2**24
    if len(left) * len(right) <= 16:
        for i, s in enumerate(left):
            for j, t in enumerate(right):
                out[i, j] = np.count_nonzero(s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t)
        return out
    tokens, rows, first, count = [], [], [], []
    for sets in (left, right):
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        rows.append(np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order])
        values = values[order]
        edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        tokens.append(values[edge])
        first.append(edge)
        count.append(np.diff(np.append(edge, len(values))))
    _, i, j = np.intersect1d(*tokens, assume_unique=True, return_indices=True)
    fa, fb, ca, cb = first[0][i], first[1][j], count[0][i], count[1][j]
    common = ca * cb > max(16, len(left) * len(right) // 128)
    wide = max(1, (4 << 20) // (len(left) + len(right)))
    at = np.flatnonzero(common)
    for k in range(0, len(at), wide):
        own = at[k : k + wide]
        sides = []
        for r, f, c, sets in ((rows[0], fa, ca, left), (rows[1], fb, cb, right)):
            m = np.zeros((len(sets), len(own)), dtype=out.dtype)
            m[r[_spread(f[own], c[own])], np.repeat(np.arange(len(own)), c[own])] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    at = np.flatnonzero(~common)
    ends = np.cumsum((ca * cb)[at])
    k = 0
    while k < len(at):
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS_AT_ONCE)))
        own, k = at[k:end], end
        times = np.repeat(cb[own], ca[own])  # each row of the left meets so many of the right
        x = np.repeat(rows[0][_spread(fa[own], ca[own])], times)
        y = rows[1][_spread(np.repeat(fb[own], ca[own]), times)]
        np.add.at(out.reshape(-1), x * len(right) + y, 1)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each set of `left` and each of `right` are similar enough."""
    both = shared_tokens(left, right)
    n, m = (np.array([len(s) for s in sets], dtype=np.int64) for sets in (left, right))
    out = np.empty(both.shape, dtype=bool)
    for i in range(0, len(n), 256):  # 100 * both >= percent * (n + m - both), in whole numbers
        out[i : i + 256] = both[i : i + 256] >= -(-percent * (n[i : i + 256, None] + m[None, :]) // (100 + percent))
    return out


def spanning(links_: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of links, as many as connect the same parts of left and right."""
    names, root = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right, root = root[: len(left)], root[len(left) :], np.arange(len(names))
    x, y = [], []
    for i in np.flatnonzero(links_.any(axis=1)):
        at = np.flatnonzero(links_[i])
        met, own = root[right[at]], root[left[i]]
        if (met == own).all():
            continue
        others, first = np.unique(met, return_index=True)
        first, others = first[others != own], others[others != own]
        x += [int(i)] * len(first)
        y += at[first].tolist()
        root[np.isin(root, others)] = own
    return np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)


def verified_blocks(blocks: DataFrame, placed: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, shared: frozenset[int], connecting: bool) -> DataFrame:
    """Links (a, b) between the nodes of the blocks' pairs. placed: node, part, block. If connecting, only links that connect parts which links of the same pair of blocks don't connect yet."""
    blocks, blocks_path = written(blocks, "blocks")
    wanted = blocks.select("ba", "bb", F.explode("nodes").alias("node"))
    whole = blocks.filter("whole").select("ba", "bb")
    paths = [blocks_path]
    if not whole.isEmpty():
        sides = whole.withColumn("block", F.explode(F.array_distinct(F.array("ba", "bb"))))
        wanted = wanted.unionByName(sides.join(placed.select("node", "block").distinct(), "block").select("ba", "bb", "node"))
    of = reps.select("node", "doc_id").join(placed.select("node", "part", "block").distinct(), "node")
    wanted, path = written(wanted.join(of, "node"), "wanted")
    paths.append(path)
    rows = _rows(docs)
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    else:  # few documents may be wanted by many pairs of blocks
        ids, path = written(wanted.select("doc_id").distinct(), "ids")
        paths.append(path)
        if ids.count() <= BROADCAST_ROWS:
            rows = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    met = rows.join(wanted, "doc_id").select("ba", "bb", "node", "part", "block", "text")

    def run(key: tuple, pairs: pa.Table, given: pa.Table) -> pa.Table:
        ba, bb = (k.as_py() for k in key)
        sets, parts, sides = {}, {}, {}
        for node, part, block, s in zip(*(given.column(c).to_pylist() for c in ("node", "part", "block")), shingle_sets(texts(given.column("text")), words), strict=True):
            if node_of(s, shared) == node:  # else another text under the same id
                sets[node], parts[node], sides[node] = s, part, block
        if pairs.column("whole")[0].as_py():
            a, b = ([node for node in sorted(sets) if sides[node] == side] for side in (ba, bb))
        else:
            a, b = ([node for node in np.frombuffer(pairs.column(c)[0].as_py(), dtype="<i8").tolist() if node in sets] for c in ("a", "b"))
        if ba == bb:
            a = b = sorted({*a, *b})
        x = y = np.empty(0, dtype=np.int64)
        if a and b and not (connecting and len({parts[node] for node in (*a, *b)}) == 1):
            found = linked([sets[node] for node in a], [sets[node] for node in b], percent)
            if ba == bb:
                found = np.triu(found, 1)
            x, y = spanning(found, *(np.array([parts[node] for node in side], dtype=np.int64) for side in (a, b))) if connecting else np.nonzero(found)
            del found
        sets.clear()
        give_back(given.nbytes)
        return pa.table({"a": pa.array(np.array(a, dtype=np.int64)[x]), "b": pa.array(np.array(b, dtype=np.int64)[y])})

    out = blocks.select("ba", "bb", "a", "b", "whole").groupBy("ba", "bb").cogroup(met.groupBy("ba", "bb")).applyInArrow(run, "a bigint, b bigint")
    out, _ = written(out, "links")
    for p in paths:
        delete(docs.sparkSession, p)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of the edges (a, b), by alternating large-star and small-star rounds."""
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # dealt anew, so that adaptive execution can split the rows of a star's centre in the join
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).repartition("u")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).repartition("u")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        e = checkpointed(small)
        now = e.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _classes(docs: DataFrame, words: int, bits: int, frequent: int, very_frequent: int, most: int) -> Classes:
    """The classes of the frequent tokens, of which at most `most` come to the driver."""
    counted, path = written(frequent_tokens(docs, words, frequent, bits), "frequent")
    least = frequent
    steps = {int(r.step): r.n for r in counted.groupBy(F.floor(F.log2("count")).alias("step")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    if sum(steps.values()) > most:
        step = next(s for s in sorted(steps) if sum(n for k, n in steps.items() if k >= s) <= most or s == max(steps))
        least = max(least, (1 << step) - 1)
    known = counted.filter(F.col("count") > least).toArrow()
    delete(docs.sparkSession, path)
    return Classes(known.column("token").to_numpy(), known.column("count").to_numpy(), bits, max(very_frequent, least))


def links(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, very_frequent: int = VERY_FREQUENT, frequent_tokens_most: int = FREQUENT_TOKENS, connecting: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' nodes (doc_id, n, node), the nodes (node, n, doc_id of the smallest, copies) and verified links (a, b) between nodes: those that connect whatever is linked, or all."""
    if not 1 <= words <= 8:
        raise ValueError("shingles have 1 to 8 words")
    spark = docs.sparkSession
    members, _ = written(nodes(docs, words), "nodes")
    shared = shared_digests(members)
    members = members.select("doc_id", "n", (F.when(F.col("node").isin(*shared), F.col("second")).otherwise(F.col("node")) if shared else F.col("node")).alias("node"))
    reps, _ = written(members.filter("node is not null and doc_id is not null").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "sets")
    bits = _bucket_bits(docs, reps.agg(F.sum("n")).first()[0] or 0)
    classes = _classes(docs, words, bits, frequent, very_frequent, frequent_tokens_most)
    held = spark.sparkContext.broadcast((classes.tokens, classes.kind))
    live, live_path = written(entries(docs, held, bits, words, percent, shared), "entries")
    held.destroy()
    known, known_path = written(blocked(live), "blocked")
    delete(spark, live_path)
    edges, alone = None, known.withColumn("part", F.col("node"))
    if connecting:  # neighbours first: what they connect needs no further pairs
        edges = verified_blocks(candidate_blocks(alone, percent, False), alone, reps, docs, words, percent, shared, True)
        alone = known.join(components(edges), "node", "left").withColumn("part", F.coalesce("root", "node"))
    more = verified_blocks(candidate_blocks(alone, percent, True), alone, reps, docs, words, percent, shared, connecting)
    delete(spark, known_path)
    return members, reps, edges.unionByName(more) if connecting else more


def link_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id and links: how many other documents each document with an id is linked with, its copies included."""
    members, reps, edges = links(docs, connecting=False, **options)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    others = both.join(reps.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    per = reps.join(others.withColumnRenamed("a", "node"), "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")).filter("links > 0")
    return _by_node(members.filter("doc_id is not null"), per).select("doc_id", F.coalesce("links", F.lit(0)).alias("links"))


def _by_node(members: DataFrame, per: DataFrame) -> DataFrame:
    """The members with their node's columns, if it has any; a node with very many copies is dealt out by salt."""
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPY_SALTS - 1).cast("bigint"))))
    return members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS).cast("bigint"))).join(salted, ["node", "salt"], "left")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    members, reps, edges = links(docs, **options)
    known = members.filter("doc_id is not null and node is not null")
    repeated = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select("doc_id", "a")
    same = known.join(repeated, "doc_id").select("a", F.col("node").alias("b")).filter("a != b").distinct()
    # components of the nodes' smallest doc_ids, so that a root is the component's id and nothing is joined by it
    ids = edges.unionByName(same)
    for side in ("a", "b"):
        ids = ids.join(reps.select(F.col("node").alias(side), F.col("doc_id").alias(f"{side}_id")), side)
    roots = components(ids.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).select(F.col("node").alias("doc_id"), "root")
    linked = reps.join(roots, "doc_id", "left").filter("copies > 1 or root is not null").select("node", F.coalesce("root", "doc_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return _by_node(members, linked).select("doc_id", F.col("n").alias("n_shingles"), component)
