"""The driver's TPC-H-like tables read as a hospital event feed.

``wire_events`` turns every row of ``events`` into the JSON message a device would send, with the
whole range of defects (missing ids, skewed clocks, unknown keys, numbers as text, copies) spread
over the rows by arithmetic on ``event_id``. Nothing is filtered: each table row becomes one message,
and some rows are sent again as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import built_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int, rest: int = 0) -> Column:
    return F.col("n") % n == rest


def _pick(index: Column, *values: str | None) -> Column:
    chosen = None
    for i, value in enumerate(values):
        chosen = F.when(index == i, F.lit(value)) if chosen is None else chosen.when(index == i, F.lit(value))
    return chosen


@built_once
def _event_type() -> Column:
    return (
        F.when(F.col("n") % 10 < 6, "patient_vital")
        .when(_every(10, 6), "device_reading")
        .when(_every(10, 7), "lab_result")
        .when(_every(10, 8), "imaging_request")
        .when(_every(30, 9), "bed_status")
        .when(_every(30, 19), "resource_update")
        .otherwise("appointment_event")
    )


def _numbered(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


@built_once
def _payload() -> Column:
    """Payload text of the row's event type (absent fields are left out, as ``to_json`` does with null)."""
    n, k, value = F.col("n"), F.col("k"), F.col("value")
    extra = F.when(_every(61), F.lit("x")).alias("note")
    vital = F.to_json(
        F.struct(
            F.when(~_every(11), F.lit(60.0) + value).alias("heart_rate"),
            F.when(~_every(13), F.lit(100.0) - k / F.lit(5.0).cast("double")).alias("spo2"),
            (F.lit(10) + k % 25).cast("double").alias("respiratory_rate"),
            (F.lit(36.0) + k / F.lit(50.0).cast("double")).alias("temperature_c"),
            (F.lit(100) + k % 40).cast("double").alias("systolic_bp"),
            (F.lit(60) + k % 30).cast("double").alias("diastolic_bp"),
            extra,
        )
    )
    # Every 59th message carries the heart rate as text, which still counts as a number.
    vital = F.when(_every(59), F.regexp_replace(vital, r'"heart_rate":([0-9.E]+)', '"heart_rate":"$1"')).otherwise(
        vital
    )
    device = F.to_json(
        F.struct(
            F.lit("spo2_probe").alias("metric"),
            value.alias("value"),
            F.when(~_every(3), F.lit("pct")).alias("unit"),
            _pick(k % 4, "good", "poor", "unknown", None).alias("quality"),
            extra,
        )
    )
    lab = F.to_json(
        F.struct(
            _numbered("lab_", n % 9).alias("test_code"),
            value.alias("value"),
            F.lit("mg").alias("unit"),
            F.when(~_every(7), k >= 80).alias("abnormal_flag"),
            extra,
        )
    )
    imaging = F.to_json(
        F.struct(
            _pick(n % 5, "CT", "MRI", "XRAY", "US", "PET").alias("modality"),
            _pick(n % 3, "chest", "head", "knee").alias("body_part"),
            (k * 2).alias("waiting_minutes"),
            _pick(k % 4, "low", "medium", "high", None).alias("acuity_hint"),
            extra,
        )
    )
    bed = F.to_json(
        F.struct(
            _numbered("ward_", n % 12).alias("ward_id"),
            _numbered("bed_", n % 40).alias("bed_id"),
            _pick(k % 4, "available", "occupied", "cleaning", "blocked").alias("status"),
            F.when(~_every(7), k / F.lit(100.0).cast("double")).alias("occupancy_ratio"),
            extra,
        )
    )
    resource = F.to_json(
        F.struct(
            _pick(n % 3, "staff", "room", "equipment").alias("resource_type"),
            _numbered("res_", n % 12).alias("resource_id"),
            (k % 20).alias("available"),
            F.when(_every(19), F.lit(0)).otherwise(F.lit(20)).alias("capacity"),
            extra,
        )
    )
    appointment = F.to_json(
        F.struct(
            _numbered("apt_", n).alias("appointment_id"),
            _pick(k % 5, "scheduled", "arrived", "in_progress", "completed", "no_show").alias("status"),
            _numbered("dep_", n % 6).alias("department"),
            F.when(~_every(4), k).alias("wait_minutes"),
            extra,
        )
    )
    kind = F.col("event_type")
    return (
        F.when(kind == "patient_vital", vital)
        .when(kind == "device_reading", device)
        .when(kind == "lab_result", lab)
        .when(kind == "imaging_request", imaging)
        .when(kind == "bed_status", bed)
        .when(kind == "resource_update", resource)
        .otherwise(appointment)
    )


# Messages cost much more than the few bytes of a row they are made from, so tasks are dealt by rows, not by bytes.
ROWS_PER_TASK = 100_000


def spread_partitions(df: DataFrame) -> int:
    """Tasks for work per row: one per so many rows, at least one per core. Counts by the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value`` (JSON text) and ``arrival_time`` of every message, copies included; rows are dealt evenly to tasks."""
    events = table(spark, sf_dir, "events")
    base = events.repartition(spread_partitions(events)).select(
        F.col("event_id").alias("n"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    base = base.withColumn("event_type", _event_type())
    kind = F.col("event_type")
    on_ward = kind.isin("bed_status", "resource_update")
    patient = F.when(_every(103), F.repeat(F.lit("p"), 120)).otherwise(_numbered("pat_", F.col("user_id")))
    clock = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = (
        F.when(_every(73), "yesterday")
        .when(_every(79), clock)
        .when(_every(2), F.concat(clock, F.lit("Z")))
        .otherwise(F.concat(clock, F.lit("+00:00")))
    )
    late = F.when(_every(89), F.lit(-600)).when(_every(83), F.lit(90_000)).otherwise(F.col("k") * 2)
    rows = base.select(
        "n",
        "k",
        kind,
        F.struct(
            _numbered("evt_", F.col("n")).alias("event_id"),
            F.lit("src_").alias("source_id"),
            kind.alias("event_type"),
            F.when(~on_ward & ~_every(97), patient).alias("patient_id"),
            F.when((kind == "device_reading") & ~_every(101), _numbered("dev_", F.col("n") % 23)).alias("device_id"),
            F.when(kind == "bed_status", _numbered("ward_", F.col("n") % 12))
            .when(kind == "resource_update", _numbered("res_", F.col("n") % 12))
            .alias("resource_id"),
            stamp.alias("timestamp"),
            F.when(_every(71), 9).otherwise(F.lit(1) + (F.col("n") % 2)).cast("int").alias("schema_version"),
            F.when(_every(67), "short")
            .otherwise(F.concat(F.lit("trace"), F.lpad(F.col("n").cast("string"), 8, "0")))
            .alias("trace_id"),
        ).alias("head"),
        _payload().alias("payload"),
        F.timestamp_micros(F.unix_micros("ts") + late * F.lit(1_000_000).cast("bigint")).alias("arrived"),
    )
    # Copies: every 20th message is sent again a second later, every 40th once more by another source.
    copies = F.array_compact(
        F.array(
            F.lit(0),
            F.when(_every(20), F.lit(1)),
            F.when(_every(40), F.lit(2)),
        )
    )
    sent = rows.withColumn("copy", F.explode(copies))
    source = F.when(F.col("copy") == 2, F.lit("src_copy")).otherwise(_numbered("src_", F.col("n") % 17))
    head = F.to_json(F.col("head").withField("source_id", source))
    opened = F.substring(head, F.lit(1), F.length(head) - 1)
    return sent.select(
        F.concat(opened, F.lit(',"payload":'), F.col("payload"), F.lit("}")).alias("value"),
        F.timestamp_micros(F.unix_micros("arrived") + F.col("copy") * 1_000_000).alias("arrival_time"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient dimension from ``customer``."""
    return table(spark, sf_dir, "customer").select(
        _numbered("pat_", F.col("c_custkey")).alias("external_ref"),
        F.col("c_name").alias("display_name"),
        _numbered("ward_", F.col("c_nationkey") % 12).alias("ward_id"),
    )
