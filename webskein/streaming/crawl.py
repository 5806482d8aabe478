"""The request log as a stream: new URLs once, and each domain's delay kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import urls
from ..operators.politeness import START, step

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def first_seen(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each URL of a stream (url, ts) once within the watermark."""
    return log.withColumn("url_hash", urls.url_hash(F.col("url"))).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url_hash"])


def windowed_counts(log: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Requests and errors of each domain and window."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", width), "domain").agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("errors")).select("domain", F.col("window.start").alias("start"), "requests", "errors")


class DelayState(StatefulProcessor):
    """Delay and run of errors of a domain."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("delay", "delay double, errors int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        delay, errors = self.state.get() if self.state.exists() else (START, 0)
        for row in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            errors = 0 if row.success else errors + 1
            delay = step(delay, row.status, errors)
        self.state.update((delay, errors))
        yield pd.DataFrame({"domain": [key[0]], "delay": [round(delay, 6)]})

    def close(self) -> None:
        pass


def delays(log: DataFrame) -> DataFrame:
    """The delay of every domain in a micro-batch after its rows; needs the settings in STATE_STORE."""
    return log.groupBy("domain").transformWithStateInPandas(DelayState(), "domain string, delay double", "update", "none")
