"""Per-domain request state and proxy health from a request log: rolling means, error runs, delays.

A log has domain, ts, seq (order within a timestamp), response_time, success and status.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLLING, PROXY_ROLLING, UNHEALTHY = 50, 20, 3
START, MIN_DELAY, MAX_DELAY, PER_SECOND, JITTER = 1.0, 0.5, 10.0, 2.0, 0.3


def _by(key: str) -> "Window":
    return Window.partitionBy(key).orderBy("ts", "seq")


def with_error_runs(log: DataFrame, key: str = "domain") -> DataFrame:
    """The log with consecutive_errors: failures since the last success, this row included."""
    island = F.sum(F.when(F.col("success"), 1).otherwise(0)).over(_by(key).rowsBetween(Window.unboundedPreceding, 0))
    marked = log.withColumn("island", island)
    run = F.sum(F.when(F.col("success"), 0).otherwise(1)).over(Window.partitionBy(key, "island").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("consecutive_errors", run).drop("island")


def rolling_response_time(log: DataFrame, size: int = ROLLING, key: str = "domain") -> DataFrame:
    """The log with avg_response_time: the mean of the last `size` successful times so far; 0 before the first."""
    recent = Window.partitionBy(key, "success").orderBy("ts", "seq").rowsBetween(1 - size, 0)
    exact = F.sum(F.col("response_time").cast("decimal(28,6)")).over(recent).cast("double")  # no order of addition matters
    last = F.last("mean", ignorenulls=True).over(_by(key).rowsBetween(Window.unboundedPreceding, 0))
    # dealt by key once, which serves both windows
    given = log.repartition(key).withColumn("mean", F.when(F.col("success"), exact / F.count("*").over(recent)))
    return given.withColumn("avg_response_time", F.coalesce(last, F.lit(0.0))).drop("mean")


def domain_stats(log: DataFrame) -> DataFrame:
    """request_count, error_count and the mean of the last successful times of each domain."""
    newest = Window.partitionBy("domain", "success").orderBy(F.desc("ts"), F.desc("seq"))
    recent = log.withColumn("rank", F.row_number().over(newest))
    return recent.groupBy("domain").agg(
        F.count("*").alias("request_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.round(F.coalesce(F.avg(F.when(F.col("success") & (F.col("rank") <= ROLLING), F.col("response_time"))), F.lit(0.0)), 3).alias("avg_response_time"),
    )


def step(delay: float, status: int, errors: int, low: float = MIN_DELAY, high: float = MAX_DELAY) -> float:
    """The delay after a response."""
    if status == 429:
        return min(delay * 3, high)
    if status >= 500 or errors >= 3:
        return min(delay * 2, high)
    return max(delay * 0.95, low) if errors == 0 and status < 400 else delay


def adaptive_delays(log: DataFrame, *, low: float = MIN_DELAY, high: float = MAX_DELAY, start: float = START) -> DataFrame:
    """The log's keys with delay: the domain's delay after each request. Each domain is folded row by row in its order, so nothing is gathered.

    A row whose crawl_delay column (if there is one) isn't null sets the delay first, to at least `low`.
    """
    if "crawl_delay" not in log.columns:
        log = log.withColumn("crawl_delay", F.lit(None).cast("double"))
    given = with_error_runs(log).select("domain", "ts", "seq", "status", "consecutive_errors", F.col("crawl_delay").cast("double").alias("crawl_delay"))
    kind = dict(given.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain, delay = object(), start
        for b in batches:
            out = []
            for d, status, errors, ordered in zip(*(b.column(c).to_pylist() for c in ("domain", "status", "consecutive_errors", "crawl_delay")), strict=True):
                if d != domain:
                    domain, delay = d, start
                if ordered is not None:
                    delay = max(ordered, low)
                delay = step(delay, status, errors, low, high)
                out.append(delay)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("domain", "ts", "seq")), pa.array(out, pa.float64())], ["domain", "ts", "seq", "delay"])

    return given.repartition("domain").sortWithinPartitions("domain", "ts", "seq").mapInArrow(run, f"domain {kind['domain']}, ts {kind['ts']}, seq {kind['seq']}, delay double")


def current_delay(delay: Column, adaptive: bool = True) -> Column:
    return delay if adaptive else F.lit(1 / PER_SECOND)


def required_waits(log: DataFrame, delays: DataFrame, jitter_seed: int | None = None) -> DataFrame:
    """domain, ts, seq, wait: what of the delay then in force was left when the request came; with a seed, with jitter."""
    both = log.select("domain", "ts", "seq").join(delays, ["domain", "ts", "seq"])
    before = F.coalesce(F.lag("delay").over(_by("domain")), F.lit(START))
    seconds = F.col("ts").cast("timestamp").cast("double")
    elapsed = seconds - F.lag(seconds).over(_by("domain"))
    wait = F.greatest(F.lit(0.0), before - F.coalesce(elapsed, F.lit(1e18)))
    if jitter_seed is not None:
        wait = F.greatest(F.lit(0.0), wait * (1 + JITTER * (2 * F.rand(jitter_seed) - 1)))
    return both.select("domain", "ts", "seq", wait.alias("wait"))


def proxy_health(log: DataFrame) -> DataFrame:
    """Per proxy (domain): usage, failures in a row, health, mean of the last successful times.

    Three failures in a row make a proxy unhealthy; a success makes it healthy again.
    """
    runs = with_error_runs(log)
    newest = Window.partitionBy("domain", "success").orderBy(F.desc("ts"), F.desc("seq"))
    recent = runs.withColumn("rank", F.row_number().over(newest))
    last = F.max_by("consecutive_errors", F.struct("ts", "seq"))
    return recent.groupBy(F.col("domain").alias("proxy")).agg(
        F.count_if("success").alias("usage_count"),
        last.alias("failure_count"),
        (last < UNHEALTHY).alias("is_healthy"),
        F.round(F.coalesce(F.avg(F.when(F.col("success") & (F.col("rank") <= PROXY_ROLLING), F.col("response_time"))), F.lit(0.0)), 6).alias("avg_response_time"),
    )


def proxy_stats(health: DataFrame) -> DataFrame:
    return health.agg(F.count("*").alias("total"), F.count_if("is_healthy").alias("healthy"), F.count_if(~F.col("is_healthy")).alias("unhealthy"))


def healthy(health: DataFrame) -> DataFrame:
    return health.filter("is_healthy")


def least_used(health: DataFrame) -> DataFrame:
    """The healthy proxy with the fewest uses; ties by name."""
    return healthy(health).orderBy("usage_count", "proxy").limit(1).select("proxy")


def round_robin(requests: DataFrame, health: DataFrame, order: str = "seq") -> DataFrame:
    """Each request's proxy: the healthy ones in turn, by the request's place in its order."""
    pool = healthy(health).select("proxy").orderBy("proxy").withColumn("k", F.expr("row_number() over (order by proxy)") - 1)
    size = pool.agg(F.count("*").alias("size"))
    # the pool is a configured list of proxies, and its size one row
    placed = requests.select(order).join(F.broadcast(size)).withColumn("k", F.when(F.col("size") > 0, F.pmod(F.col(order), F.col("size"))))
    return placed.join(F.broadcast(pool), "k", "left").select(order, "proxy")


def proxy_urls(proxy: Column) -> Column:
    """What an HTTP client takes: the proxy for both schemes; null without a proxy."""
    return F.when(proxy.isNotNull(), F.create_map(F.lit("http://"), proxy, F.lit("https://"), proxy))
