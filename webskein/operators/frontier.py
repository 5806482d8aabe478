"""The crawl frontier as tables: waves of a prioritised breadth-first search, retries, and a scored queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import checkpointed
from ..sources import stores

CRITICAL, HIGH, NORMAL, LOW, DEFERRED = range(5)
EXTERNAL_LINKS, MAX_RETRIES = 10, 3
SCHEMA = "url string, url_hash string, priority int, depth int, parent_url string, seq bigint"


def seeds(df: DataFrame) -> DataFrame:
    """Entries of the start URLs, numbered in their order."""
    placed = stores.numbered(df.select("url"), "url", 1)
    return placed.select("url", urls.url_hash(F.col("url")).alias("url_hash"), F.lit(CRITICAL).alias("priority"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.col("place").cast("bigint").alias("seq"))


def expanded(entries: DataFrame, edges: DataFrame, follow_external: bool = False) -> DataFrame:
    """Candidates behind the entries: internal links, and if asked for the first external ones of each page at low priority."""
    own = edges.join(entries.select(F.col("url").alias("src"), F.col("depth").alias("d"), F.col("seq").alias("s")), "src")
    place = F.row_number().over(Window.partitionBy("src", "is_internal").orderBy("pos"))
    own = own.withColumn("place", place).filter(F.col("is_internal") | (F.lit(follow_external) & (F.col("place") <= EXTERNAL_LINKS)))
    return own.select(F.col("dst").alias("url"), urls.url_hash(F.col("dst")).alias("url_hash"), F.when(F.col("is_internal"), NORMAL).otherwise(DEFERRED).alias("priority"), (F.col("d") + 1).cast("int").alias("depth"), F.col("src").alias("parent_url"), F.col("s").alias("s"), "pos")


def admitted(candidates: DataFrame, seen: DataFrame, *, max_depth: int, room: int | None = None) -> DataFrame:
    """Candidates that are new, not too deep, one for each hash (the first to come), and no more than there's room for."""
    fresh = candidates.join(seen.select("url_hash"), "url_hash", "left_anti").filter(F.col("depth") <= max_depth)
    first = Window.partitionBy("url_hash").orderBy("priority", "s", "pos", "parent_url", "url")
    out = fresh.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")
    return out if room is None else out.orderBy("priority", "depth", "s", "pos", "url").limit(room)


def skipped(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """How many candidates were seen before."""
    return candidates.join(seen.select("url_hash"), "url_hash", "left_semi").agg(F.count("*").alias("duplicates_skipped"))


def next_batch(frontier: DataFrame, k: int) -> DataFrame:
    """The entries to take next: lowest priority number first, then depth, then order of arrival."""
    return frontier.orderBy("priority", "depth", "seq").limit(k)


def crawl(start: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], *, max_depth: int = 5, max_urls: int | None = None, follow_external: bool = False) -> DataFrame:
    """All entries that are reached from the start, wave by wave. Each wave is checkpointed."""
    wave = reached = checkpointed(seeds(start))
    for depth in range(1, max_depth + 1):
        found = expanded(wave, edges(wave) if callable(edges) else edges, follow_external)
        known = reached.count()
        room = None if max_urls is None else max(0, max_urls - known)
        wave = admitted(found, reached, max_depth=max_depth, room=room)
        placed = stores.numbered(wave.withColumn("order", F.struct("s", "pos", "url")), "order", 1)
        wave = checkpointed(placed.withColumn("seq", F.col("place") + known).select("url", "url_hash", "priority", "depth", "parent_url", "seq"))
        if not wave.head(1):
            break
        reached = checkpointed(reached.unionByName(wave))
    return reached


def is_seen(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """The wanted URLs with whether they were seen."""
    hashed = wanted.select("url", urls.url_hash(F.col("url")).alias("url_hash"))
    known = seen.select("url_hash").distinct().withColumn("known", F.lit(True))
    return hashed.join(known, "url_hash", "left").select("url", F.coalesce("known", F.lit(False)).alias("is_seen"))


def failures(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """url_hash, failures and retry: whether a URL that failed so often is tried again."""
    return log.groupBy(urls.url_hash(F.col("url")).alias("url_hash")).agg(F.count("*").alias("failures")).withColumn("retry", F.col("failures") < max_retries)


def stats(frontier: DataFrame, seen: DataFrame, crawled: DataFrame, failed: DataFrame) -> DataFrame:
    """One row of counts."""
    parts = [("queue_size", frontier), ("seen", seen), ("crawled", crawled), ("failed", failed)]
    rows = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name, _ in parts))


class ScoredQueue:
    """A queue table (url, score) and a seen table (url_hash); higher scores go first. Every method returns new tables."""

    def __init__(self, queue: DataFrame, seen: DataFrame):
        self.queue, self.seen = queue, seen

    def push(self, items: DataFrame) -> "ScoredQueue":
        """Add what wasn't seen; of a URL that comes twice the highest score counts."""
        new = items.withColumn("url_hash", urls.url_hash(F.col("url"))).join(self.seen, "url_hash", "left_anti").groupBy("url_hash").agg(F.max("score").alias("score"), F.min("url").alias("url"))
        return ScoredQueue(self.queue.unionByName(new.select("url", "score")), self.seen.unionByName(new.select("url_hash")))

    def peek(self, k: int) -> DataFrame:
        return self.queue.orderBy(F.desc("score"), F.desc("url")).limit(k)

    def pop(self, k: int) -> tuple[DataFrame, "ScoredQueue"]:
        top = self.peek(k)
        return top, ScoredQueue(self.queue.join(top.select("url"), "url", "left_anti").select("url", "score"), self.seen)

    def mark_seen(self, items: DataFrame) -> "ScoredQueue":
        return ScoredQueue(self.queue, self.seen.unionByName(items.select(urls.url_hash(F.col("url")).alias("url_hash"))).distinct())

    def sizes(self) -> DataFrame:
        rows = self.queue.select(F.lit(0).alias("k")).unionByName(self.seen.select(F.lit(1).alias("k")))
        return rows.agg(F.count_if(F.col("k") == 0).alias("size"), F.count_if(F.col("k") == 1).alias("seen"))

    def clear(self) -> "ScoredQueue":
        return ScoredQueue(self.queue.limit(0), self.seen.limit(0))
