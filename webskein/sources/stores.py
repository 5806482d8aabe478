"""Stores and sinks of page records: first-wins and last-wins tables, partial updates, JSON batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import checkpointed

BATCH = 100


def stamped(pages: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return pages.withColumn("crawled_at", now).withColumn("updated_at", now)


def insert_if_absent(store: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The rows to append: of each URL that the store lacks the first to come."""
    first = Window.partitionBy("url").orderBy(order)
    return new.join(store.select("url"), "url", "left_anti").withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")


def upsert(store: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The table after whole-row upserts: of each URL the last to come; rows without URL are refused."""
    both = store.withColumn("newer", F.lit(0)).unionByName(new.withColumn("newer", F.lit(1)))
    last = Window.partitionBy("url").orderBy(F.desc("newer"), F.desc(order))
    return both.filter("url is not null and url <> ''").withColumn("place", F.row_number().over(last)).filter("place = 1").drop("place", "newer")


def update(store: DataFrame, changes: DataFrame, now: Column | None = None, order: str | None = None) -> DataFrame:
    """The table after partial updates by URL: what a change gives (not null) replaces what was; URLs that the store lacks change nothing.

    Of several changes of a URL the last one (by the changes' column `order`, else any) that gives a value counts.
    """
    given = [c for c in changes.columns if c not in ("url", order)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.first(c, ignorenulls=True)
    folded = changes.groupBy("url").agg(F.lit(True).alias("changed"), *(last(c).alias(f"new_{c}") for c in given))
    joined = store.join(folded, "url", "left")
    out = joined.select(*(F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in store.columns), "changed")
    if "updated_at" in store.columns and now is not None:
        out = out.withColumn("updated_at", F.when(F.col("changed"), now).otherwise(F.col("updated_at")))
    return out.drop("changed")


def json_batches(pages: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """batch (from 1), count and file name of each batch of pages in order; places are counted by range, so no task has all rows."""
    return numbered(pages, order, size).groupBy("batch").agg(F.count("*").alias("count")).withColumn("file", F.format_string("batch_%04d.json", F.col("batch")))


def numbered(pages: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """Pages with batch and place (from 1), by the ranges' row counts (a row per range is joined back).

    The range-sorted rows are checkpointed with their range's number: counts and rows come from the same ranges, however
    wide the rows are and however partitions are coalesced. Rows of equal order are numbered as they lie in the checkpoint.
    """
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ("_part", "_row", "_inside", "_before")
    dealt = checkpointed(pages.repartitionByRange(ranges, order).withColumn(own[0], F.spark_partition_id()).withColumn(own[1], F.monotonically_increasing_id()))
    counts = dealt.groupBy(own[0]).agg(F.count("*").alias("n"))
    before = counts.select(own[0], F.coalesce(F.sum("n").over(Window.orderBy(own[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(own[3]))
    inside = F.row_number().over(Window.partitionBy(own[0]).orderBy(order, own[1]))
    known = F.coalesce(own[3], F.raise_error(F.lit("a range has no count")).cast("bigint"))
    placed = dealt.withColumn(own[2], inside).join(F.broadcast(before), own[0], "left").withColumn("place", F.col(own[2]) + known)
    return placed.withColumn("batch", (F.floor((F.col("place") - 1) / size) + 1).cast("int")).drop(*own)


def write_json_batches(pages: DataFrame, folder: str, order: str, size: int = BATCH, now: str = "") -> None:
    """One JSON line per batch: batch, count, timestamp and pages."""
    rows = numbered(pages, order, size)
    page = F.struct(*(F.col(c) for c in pages.columns))
    batches = rows.groupBy("batch").agg(F.count("*").alias("count"), F.lit(now).alias("timestamp"), F.transform(F.array_sort(F.collect_list(F.struct("place", page.alias("page")))), lambda s: s["page"]).alias("pages"))
    batches.write.mode("overwrite").json(folder)


def single_file_name(url: Column) -> Column:
    return F.concat(F.lit("page_"), F.substring(F.md5(url), 1, 12), F.lit(".json"))


def write_json_pages(pages: DataFrame, folder: str) -> None:
    """Every page as a JSON text of its own, in a folder named after its file name."""
    rows = pages.select(F.to_json(F.struct(*(F.col(c) for c in pages.columns))).alias("value"), single_file_name(F.col("url")).alias("file"))
    rows.repartition("file").write.mode("overwrite").partitionBy("file").text(folder)


def output_stats(pages: DataFrame, size: int = BATCH) -> DataFrame:
    """total_pages, batches_written and pending of a buffer that is flushed every `size` pages."""
    return pages.agg(F.count("*").alias("total_pages")).select("total_pages", F.floor(F.col("total_pages") / size).alias("batches_written"), F.pmod("total_pages", F.lit(size)).alias("pending"))


def summary(pages: DataFrame, failed: DataFrame, seconds: float) -> DataFrame:
    """One row: pages crawled and failed, seconds, and pages a second (null for no time)."""
    rows = pages.select(F.lit(1).alias("ok")).unionByName(failed.select(F.lit(0).alias("ok")))
    return rows.agg(F.count_if(F.col("ok") == 1).alias("pages_crawled"), F.count_if(F.col("ok") == 0).alias("pages_failed")).withColumn("duration_seconds", F.lit(float(seconds))).withColumn("pages_per_second", F.when(F.col("duration_seconds") > 0, F.round(F.col("pages_crawled") / F.col("duration_seconds"), 6)))


def create_table(pages: DataFrame, name: str, mode: str = "error") -> None:
    pages.write.mode(mode).saveAsTable(name)


def drop_table(spark, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def page_hash(url: Column) -> Column:
    return urls.url_hash(url)
