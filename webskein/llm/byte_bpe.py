"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut where the pre-tokenizer cuts in any case: around white space, and in long runs between a letter and a
punctuation mark. The library encodes every distinct piece once (pieces of Latin characters are pre-tokenized and mapped
from bytes to characters here, and merged by its model), and a worker remembers the ids of short pieces (at most
REMEMBERED of them), so a text's ids are joined from those of its pieces. The pieces of a text of Latin characters alone
are the matches of the pattern. What the pattern itself doesn't cut, such as
millions of letters in a row, goes to the library as one piece, in memory in proportion to it (about 200 bytes a
letter). Decoding joins the bytes of the ids by the byte table before any character is read; offsets follow from the
lengths of the ids' bytes and the table of characters by bytes.

Null texts count as empty. Empty texts have no ids. Equal texts give equal rows; every input row gives one output row,
whatever its id (null or repeated); columns of other names pass by `encode(keep=...)`, and names that clash with the
operator's own are replaced by them. An empty table gives an empty table. Strings of special tokens in a text are
ordinary text, unless a ByteBpe is asked to read them as such.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import caches, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Characters that are given to the library in one call.
CALL = 1 << 19
#: Pieces that a worker remembers, and their longest.
REMEMBERED, SHORT = 400_000, 64
#: Runs without white space that are longer are cut before punctuation.
LONG = 2048
_LETTER = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
_MARK = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: Places where every match of the pre-tokenizer's pattern ends: between a letter and a space before a letter, or a mark.
_SAFE = re.compile(rf"[A-Za-z](?= [A-Za-z])|[{_LETTER}](?=[{_MARK}])")
_BEFORE_MARK = re.compile(rf"(?<=[{_LETTER}])(?=[{_MARK}])")
#: The pattern's cuts around plain white space; characters that some library may take for white space besides.
_PIECE = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: The pre-tokenizer's pattern, for texts of Latin characters (to U+024F) without other white space.
_LATIN = re.compile(r" ?[{l}]+| ?[{n}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\t-\r {l}{n}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+".format(l="A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", n="0-9\xb2\xb3\xb9\xbc-\xbe"))
_BEYOND = re.compile("[^\x00-ɏ]")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Either of them: a text without such a character is cut by _LATIN as a whole.
_NOT_LATIN = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict[str, bytes]):
    """The ids of pieces; those of a match of the pattern that isn't known yet are found by `merged`."""

    def __init__(self, merged: Callable[[str], bytes]):
        super().__init__()
        self.merged = merged
        self.long: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.merged(word)
        if len(word) > SHORT:
            self.long.append(word)
        return ids

    def shrink(self) -> None:
        """Forget long pieces, and all of them where they are too many."""
        for p in self.long:
            self.pop(p, None)
        self.long.clear()
        if len(self) > REMEMBERED:
            self.clear()


class ByteBpe:
    """A vocabulary file, its encoder, and the bytes of every id."""

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        back = {c: b for b, c in byte_characters().items()}
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(added.values()) if special else []
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = added[i].encode() if i in added else bytes(back[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.memo = _Memo(self.merged)
        self.merge = self.tokenizer.model.tokenize
        stands = byte_characters()
        self.characters = str.maketrans({chr(i): "".join(stands[b] for b in chr(i).encode()) for i in range(0x250)})

    def merged(self, word: str) -> bytes:
        """The ids of a match of the pattern: the library's merges on the characters that stand for the bytes."""
        return array("I", [t.id for t in self.merge(word.translate(self.characters))]).tobytes()

    @staticmethod
    def cuts(text: str, size: int = CALL) -> Iterator[str]:
        """The text in parts of about `size` characters that encode to the same ids as the whole."""
        at = 0
        while len(text) - at > size and (m := _SAFE.search(text, at + size)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text in pieces that encode to the same ids as the whole: mostly a word and the space before it."""
        if _OTHER_SPACE.search(text):
            return [text]
        found = _PIECE.findall(text)
        if max(map(len, found), default=0) <= LONG:
            return found
        return [part for p in found for part in ([p] if len(p) <= LONG else _BEFORE_MARK.split(p))]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        queue: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            new = [p for p in set().union(*(ps for _, ps in queue)) if p not in self.memo]
            rest = []
            for p in new:
                if len(p) > LONG or not p.isascii() and _BEYOND.search(p) or _OTHER_SPACE.search(p):
                    rest.append(p)
                else:
                    self.memo[p] = b"".join(map(self.memo.__getitem__, _LATIN.findall(p)))
            for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.memo[p] = array("I", e.ids).tobytes()
            for i, ps in queue:
                out[i].append(b"".join(map(self.memo.__getitem__, ps)))
            self.memo.long += (p for p in new if len(p) > SHORT)
            self.memo.shrink()
            queue.clear()

        for i, text in enumerate(texts):
            if any(s in text for s in self.special):  # such a string may cut a run of white space
                out[i].append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            if not _NOT_LATIN.search(text):
                for part in self.cuts(text):
                    out[i].append(b"".join(map(self.memo.__getitem__, _LATIN.findall(part))))
                    self.memo.shrink()
                continue
            for part in self.cuts(text):
                queue.append((i, self.pieces(part)))
                size += len(part)
                if size >= CALL:
                    flush()
                    size = 0
        if queue:
            flush()
        return [b"".join(parts) for parts in out]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(b, dtype="<u4") for b in self.packed(texts)]

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every id in characters of the text with these bytes; a character that several ids share is in the range of each."""
        end = np.cumsum(self.sizes[ids])
        first = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        character = np.cumsum(first) - 1
        return character[end - self.sizes[ids]], character[end - 1] + 1

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, joined before any character is read: characters split between ids come together."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def vocabulary(path: str = VOCABULARY, special: bool = False) -> ByteBpe:
    return ByteBpe(path, special)


caches.append(vocabulary.cache_clear)


def encode(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """The kept columns and ids array<int>; with offsets also starts and ends (array<int>, in characters)."""
    from pyspark.sql import functions as F

    names = [k for k in keep if k not in ("text", "ids", "starts", "ends")]
    given = docs.select(*names, F.col(text).cast("string").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in names), "ids array<int>", *(["starts array<int>", "ends array<int>"] if offsets else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in slices(batches):
            given = [t or "" for t in b.column("text").to_pylist()]
            found = bpe.encode(given)
            columns = [b.column(n) for n in names] + [pa.array([i.astype(np.int32) for i in found], pa.list_(pa.int32()))]
            if offsets:
                ranges = [bpe.offsets(i, t.encode()) for i, t in zip(found, given, strict=True)]
                columns += [pa.array([r[k].astype(np.int32) for r in ranges], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids", *(["starts", "ends"] if offsets else [])])

    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """The kept columns, data (binary) and text (null if the bytes aren't whole UTF-8 characters)."""
    from pyspark.sql import functions as F

    names = [k for k in keep if k not in ("ids", "data", "text")]
    given = encoded.select(*names, F.col(ids).alias("ids"))
    types = {f.name: f.dataType.simpleString() for f in given.schema}

    def whole(data: bytes) -> str | None:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            data = [bpe.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(data, pa.binary()), pa.array(map(whole, data), pa.string())], [*names, "data", "text"])

    return given.mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in names), "data binary", "text string"]))


def round_trip(docs: DataFrame, *, path: str = VOCABULARY) -> DataFrame:
    """Per row of documents: doc_id, n_tokens, ids_sha256, the decoded bytes' sha256, and offsets_sha256 (starts, then ends, of the ids in characters as little-endian unsigned 32-bit integers)."""
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256")

    def row(bpe: ByteBpe, text: str, packed: bytes) -> tuple[int, str, str, str]:
        ids = np.frombuffer(packed, dtype="<u4")
        places = np.concatenate(bpe.offsets(ids, text.encode())).astype("<u4")
        return len(ids), *(hashlib.sha256(x).hexdigest() for x in (packed, bpe.decode(ids.tolist()), places.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in slices(batches):
            given = [t or "" for t in b.column("text").to_pylist()]
            distinct = list(dict.fromkeys(given))
            done = {t: row(bpe, t, p) for t, p in zip(distinct, bpe.packed(distinct), strict=True)}
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([done[t][0] for t in given], pa.int64()), *(pa.array([done[t][k] for t in given], pa.string()) for k in (1, 2, 3))],
                ["doc_id", *names],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
