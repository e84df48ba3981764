"""The latest feature vector per patient as a stored table that a stream keeps up to date.

Each micro-batch adds a delta (its newest vector per patient) laid out by a hash bucket of the patient. Every so many batches
base and deltas become a new base under the last batch's number, without what has outlived its time. A reader merges the
newest complete base with the deltas after it; a look-up of one patient reads one bucket of each. Storage and
reading follow the patients seen within the time to live, not history.

A folder counts once Spark has marked it complete, and a batch that runs again writes the same rows to its own folder,
so a crash at any point leaves a readable table. The reader's time must not lie before the newest vector's arrival: as in
a cache, older states are gone. Vectors without a patient are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tributary.operators.dedup import keep_first
from tributary.settings import DEFAULTS, Settings

BUCKETS = 64


def bucket_of(patient: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(patient), F.lit(buckets)).cast("int")


def newest_first() -> list[Column]:
    return [F.col("arrival_time").desc(), F.col("event_id").desc()]


def _complete(spark: SparkSession, folder: str, key: str) -> list[int]:
    """Numbers of the folders ``key=<number>`` that were written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(folder)):
        return []
    names = [f.getPath().getName() for f in system.listStatus(path(folder))]
    numbers = [int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}=")]
    return sorted(n for n in numbers if system.exists(path(f"{folder}/{key}={n}/_SUCCESS")))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _merged(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The newest base and the deltas after it, each patient up to once in each of them, with the bucket."""
    full = StructType([*schema.fields, StructField("bucket", IntegerType())])
    bases = _complete(spark, f"{folder}/base", "upto")
    last = bases[-1] if bases else -1
    rows = spark.createDataFrame([], full)
    if bases:
        rows = spark.read.schema(full).parquet(f"{folder}/base/upto={last}")
    later = [f"{folder}/delta/batch_id={n}" for n in _complete(spark, f"{folder}/delta", "batch_id") if n > last]
    if later:
        deltas = spark.read.schema(full).option("basePath", f"{folder}/delta").parquet(*later).select(*full.names)
        rows = rows.unionByName(deltas) if bases else deltas
    return rows


def _write(rows: DataFrame, folder: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def compact(spark: SparkSession, folder: str, batch_id: int, schema: StructType, settings: Settings = DEFAULTS) -> None:
    """Makes base and deltas up to ``batch_id`` a new base; what the base before the last one needed is removed."""
    before = _complete(spark, f"{folder}/base", "upto")
    if batch_id in before:
        return
    rows = _merged(spark, folder, schema)
    # One row; no reader comes with a time before it.
    newest = rows.agg(F.max("arrival_time").alias("_newest"))
    live = rows.join(F.broadcast(newest)).filter(
        F.col("arrival_time") > F.col("_newest") - F.expr(f"interval {settings.feature_ttl_s} seconds")
    )
    _write(keep_first(live.drop("_newest"), ["patient_id"], newest_first()), f"{folder}/base/upto={batch_id}")
    for n in before[:-1]:
        _remove(spark, f"{folder}/base/upto={n}")
    for n in _complete(spark, f"{folder}/delta", "batch_id"):
        if before and n <= before[-1]:
            _remove(spark, f"{folder}/delta/batch_id={n}")


def run_latest_features(
    vectors: DataFrame,
    folder: str,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    buckets: int = BUCKETS,
    compact_every: int = 20,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keeps the table under ``folder`` up to date with a stream of feature vectors."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        known = rows.filter(F.coalesce(F.col("patient_id"), F.lit("")) != "")
        newest = keep_first(known, ["patient_id"], newest_first())
        _write(newest.withColumn("bucket", bucket_of(F.col("patient_id"), buckets)), f"{folder}/delta/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(rows.sparkSession, folder, batch_id, rows.schema, settings)

    writer = vectors.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stored_latest_features(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    as_of: Column,
    patient: str | None = None,
    settings: Settings = DEFAULTS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """What ``features.latest_features`` gives on all vectors so far, of every patient or one, out of the stored table."""
    rows = _merged(spark, folder, schema)
    if patient is not None:
        rows = rows.filter((F.col("bucket") == bucket_of(F.lit(patient), buckets)) & (F.col("patient_id") == patient))
    live = rows.filter(
        (F.col("arrival_time") <= as_of)
        & (F.col("arrival_time") > as_of - F.expr(f"interval {settings.feature_ttl_s} seconds"))
    )
    return keep_first(live, ["patient_id"], newest_first()).drop("bucket")
