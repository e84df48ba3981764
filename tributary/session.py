"""Session settings for local runs (tests, bench); a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, name: str = "tributary") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRIBUTARY_DRIVER_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_engine_settings(spark)
    return spark


def use_engine_settings(spark: SparkSession) -> None:
    """Settings the results rely on: times in UTC, and timestamps stored so that filters can skip by them.

    State of streams lives in RocksDB, on disk, and only its changes go to the checkpoint, so a micro-batch's cost does not
    grow with the state. A query keeps the store it was started with.

    The Java machine compiles no method above 8,000 bytecodes. Where whole-stage code has one (the checks of a message), it
    would be interpreted for every row, so Spark is to make that stage's projections singly, in small methods.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


@contextmanager
def shuffled_by(spark: SparkSession, partitions: int) -> Iterator[None]:
    """So many shuffle partitions for the streams that are started and run inside.

    A stream has no adaptive execution: each micro-batch pays a task, a state store and often a Python worker for every
    partition of the session's setting, however few rows there are. The checkpoint keeps the number it was started with.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def dealt_by_rows(spark: SparkSession, tasks: int) -> Iterator[None]:
    """So many tasks for every scan and every shuffle of the actions inside.

    Spark packs up to 128 MB of files into a map task and merges shuffle partitions up to 64 MB, so a task that sorts wide rows
    holds more of them the larger the tables are, and spills. Tasks set by rows hold the same at any size.
    """
    wanted = {
        "spark.sql.files.minPartitionNum": str(tasks),
        "spark.sql.shuffle.partitions": str(tasks),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only where it is unset and the session is local is a temporary folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
