"""Session settings that the library's plans rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; conf's underscores stand for dots."""
    builder = SparkSession.builder.appName("webskein")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cpus: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return session(f"local[{n}]", spark_sql_shuffle_partitions=str(n), spark_driver_memory="8g")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one given by setCheckpointDir. Where both are unset, a local master gets one of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    given = spark.sparkContext.getCheckpointDir()
    if given:
        return given
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir isn't set: executors of {master} need a folder that they share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="webskein-")
        atexit.register(shutil.rmtree, _own[app], True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder: its lineage is cut and it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df for work that is costly a row: dealt out anew only if it has fewer partitions than there are cores (a small file is one)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows with at most about `most` bytes in a column of strings, or of one row: a batch has up to 10,000 rows of any length."""
    for b in batches:
        first = size = 0
        for i, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
            if i > first and size + (n or 0) > most:
                yield b.slice(first, i - first)
                first, size = i, 0
            size += n or 0
        if first < b.num_rows:
            yield b.slice(first)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application: they need not run where it can be imported."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="webskein-"))
    with zipfile.ZipFile(folder / "webskein.zip", "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(folder / "webskein.zip"))
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(app)
