"""WARC archives with a two-level capture index.

`archive` writes a record per page (gzip members, one file a task) into a shared folder. Of pages with equal payloads
the one with the largest page_id is a response and the others are revisits of it. `index` sorts the captures by
reversed-host URL key and page_id into compressed blocks of BLOCK_LINES lines, one file a range, and keeps for each file
a directory with the first key of every block; the first keys of the files are the top level, which has a row per file.
`lookup` searches both levels by bisection, reads the block's range, bisects in it, and reads the record's range.

A null html is an empty payload; a null url has the empty key; a null page_id counts as smallest, and refers_to is null
where the response's page_id is. Of repeated rows of one page_id and payload one is the response. Payloads of any size
are one record. Files carry the number of the task attempt that wrote them and captures name their file, so attempts
that are repeated after a lost executor don't disturb what others have read. Pages are told apart by their place in the
scan: a table whose rows don't come in the same order each time (the result of a shuffle) must be written first. Columns of other names aren't read. An
empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

BLOCK_LINES = 1000
#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 0
#: A payload with more than this part of all rows is hot.
HOT = 1000
#: Records that a task looks up on average.
LOOKUPS = 20_000
#: Archive files that a task keeps open.
OPEN_FILES = 32
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """The sort-friendly key of a URL: host labels from the last to the first, then what follows the host."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(host == "", rest).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record as one gzip member. A revisit has the HTTP head of the full payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    named = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{named(page_id)}>",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + urllib.parse.quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Page-ID: {json.dumps(page_id)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:uuid:{named(refers_to)}>", f"WARC-Refers-To-Page-ID: {json.dumps(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def parse(member: bytes) -> dict:
    """Fields of a record read back: page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and digest(payload) != said:
        raise ValueError("a record's payload doesn't have its digest")
    return {
        "page_id": json.loads(fields["warc-page-id"]),
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "refers_to": json.loads(fields["warc-refers-to-page-id"]) if revisit else None,
        "payload": None if revisit else payload,
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
        "payload_digest": said,
    }


def records(data: bytes) -> Iterator[dict]:
    """All records of an archive file in order."""
    while data:
        d = zlib.decompressobj(31)
        d.decompress(data)
        size = len(data) - len(d.unused_data)
        yield parse(data[:size])
        data = data[size:]


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder, by the libraries that Python workers have: local and NFS paths, hdfs, s3 (also as s3a or s3n), gs and abfs."""
    scheme = folder.partition(":")[0]
    if scheme in ("s3a", "s3n"):
        folder = "s3" + folder[3:]
    try:
        return pa.fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"archives can't be kept in {folder}: Python workers have no file system for {scheme}; set spark.checkpoint.dir to one that they have") from e


def _task_name() -> str:
    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; per page url_key, page_id, file, offset and length. The result is lazy: write it before it is used twice."""
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    brief = base.select("row", "page_id", F.sha1(F.encode("html", "utf-8")).alias("sha1"), F.octet_length("html").alias("size"))
    first, _ = written(brief.filter(F.col("size") >= LEAST_BYTES).groupBy("sha1").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "copies")
    hot = F.col("copies") > F.lit(pages.count() / HOT)
    # payloads with more than a HOT-th of all rows, so fewer than HOT of them, are looked up by broadcast; others meet their rows by digest
    common = F.broadcast(first.filter(hot).select("sha1", F.col("first").alias("common")))
    rare = first.filter(~hot).select(F.col("sha1").alias("key"), F.col("first").alias("rare"))
    looked_up = brief.join(common, "sha1", "left").withColumn("key", F.when(F.col("common").isNotNull(), F.col("row").cast("string")).otherwise(F.col("sha1")))
    found = looked_up.join(rare, "key", "left").withColumn("first", F.coalesce("common", "rare"))
    kinds = found.select("row", (F.col("first").isNotNull() & (F.col("row") != F.col("first.row"))).alias("revisit"), F.col("first.page_id").alias("refers_to"))
    given = base.join(kinds, "row").select("row", "page_id", url_key(F.col("url")).alias("url_key"), "url", "html", "revisit", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, root = _place(folder)
                fs.create_dir(f"{root}/warc")
                name = f"warc/{_task_name()}.warc.gz"
                out, at = fs.open_output_stream(f"{root}/{name}", compression=None), 0
            offsets, lengths = [], []
            for page_id, url, html, revisit, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to")), strict=True):
                member = record(page_id, url, html.encode(), refers_to, revisit)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([b.column("url_key"), b.column("page_id"), pa.array([name] * b.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["url_key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return given.sortWithinPartitions("row").mapInArrow(run, "url_key string, page_id bigint, file string, offset bigint, length bigint")


def _key(url_key: str, page_id: int | None) -> tuple[bytes, bool, int]:
    """Orders as Spark orders (url_key, page_id)."""
    return url_key.encode(), page_id is not None, page_id or 0


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted blocks and their directories; per index file its first key (url_key, page_id) and its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []
        blocks: list[tuple] = []
        out, at = None, 0

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(block)
            blocks.append((lines[0][0], lines[0][1], at, len(block)))
            at += len(block)
            lines.clear()

        for b in batches:
            for line in zip(*(b.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    fs, root = _place(folder)
                    fs.create_dir(f"{root}/index")
                    name = f"index/{_task_name()}"
                    out = fs.open_output_stream(f"{root}/{name}.cdx")
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir") as d:
                d.write(zlib.compress("\n".join(json.dumps(x) for x in blocks).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([blocks[0][0]], pa.string()), pa.array([blocks[0][1]], pa.int64()), pa.array([name], pa.string())], ["url_key", "page_id", "name"])

    dealt = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return dealt.mapInArrow(run, "url_key string, page_id bigint, name string")


class Reader:
    """Finds captures in an index and reads their records; top: sorted (key, index file)."""

    def __init__(self, folder: str, top: list[tuple]):
        self.fs, self.root = _place(folder)
        self.firsts, self.names = [k for k, _ in top], [n for _, n in top]
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, [], [])
        self.files: dict = {}

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.files[name].read_at(length, offset)

    def _directory(self, name: str) -> tuple[list, list]:
        if self.directory[0] != name:
            with self.fs.open_input_stream(f"{self.root}/{name}.dir") as f:
                rows = [json.loads(x) for x in zlib.decompress(f.read()).split(b"\n")]
            self.directory = (name, [_key(r[0], r[1]) for r in rows], [(r[2], r[3]) for r in rows])
        return self.directory[1], self.directory[2]

    def _lines(self, name: str, offset: int, length: int) -> tuple[list, list]:
        if self.block[0] != (name, offset):
            rows = [json.loads(x) for x in zlib.decompress(self._range(f"{name}.cdx", offset, length)).split(b"\n")]
            self.block = ((name, offset), [_key(r[0], r[1]) for r in rows], rows)
        return self.block[1], self.block[2]

    def captures(self, url_key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of every capture under the key."""
        key = _key(url_key, page_id)
        for f in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.firsts)):
            if self.firsts[f] > key:
                return
            firsts, places = self._directory(self.names[f])
            for b in range(max(0, bisect.bisect_left(firsts, key) - 1), len(firsts)):
                if firsts[b] > key:
                    return
                keys, rows = self._lines(self.names[f], *places[b])
                for i in range(bisect.bisect_left(keys, key), len(keys)):
                    if keys[i] != key:
                        return
                    yield rows[i][2], rows[i][3], rows[i][4]

    def records(self, url_key: str, page_id: int | None) -> Iterator[dict]:
        for file, offset, length in self.captures(url_key, page_id):
            yield parse(self._range(file, offset, length))


def lookup(keys: DataFrame, folder: str, files: DataFrame) -> DataFrame:
    """Records of the distinct (url_key, page_id) that are asked for, through the index; files: what index() returned."""
    top = sorted((_key(r.url_key, r.page_id), r.name) for r in files.collect())  # a row per index file
    held = keys.sparkSession.sparkContext.broadcast(top)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, size = None, [], 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], list(names))
            rows.clear()
            return out

        for b in batches:
            reader = reader or Reader(folder, held.value)
            for url_key_, page_id in zip(b.column("url_key").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                for r in reader.records(url_key_, page_id):
                    rows.append(r)
                    size += r["payload_bytes"]
                    if size > 4 << 20:
                        yield batch()
                        size = 0
        if rows:
            yield batch()

    # an explicit number of ranges: the keys are narrow, but each costs a payload
    ranges = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // LOOKUPS))
    asked = keys.select("url_key", "page_id").distinct().repartitionByRange(ranges, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return asked.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def build(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives and index into the folder; the index files, a small written table."""
    captures, _ = written(archive(pages, folder), "captures")
    files, _ = written(index(captures, folder), "index-files")
    return files


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, then look every page up through the index and read its record back."""
    folder = scratch(pages.sparkSession, "warc")
    files = build(pages, folder)
    keys = pages.select(url_key(F.col("url")).alias("url_key"), F.col("page_id").cast("bigint").alias("page_id"))
    return lookup(keys, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS m FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM d
"""
