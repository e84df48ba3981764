"""The stages put together over the driver's tables.

Checked and accepted events, quarantine, feature vectors, predictions, decisions and alerts are stage tables: each is written once per session
to the shared folder and read from there, so that a query on a late stage neither parses the messages
again nor carries the whole lineage. All other steps are lazy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.alerts import open_alerts
from tributary.operators.breaker import call_outcomes, logged_calls
from tributary.operators.decisions import decide
from tributary.operators.dedup import dedup_events
from tributary.operators.features import feature_vectors
from tributary.operators.models import predict_released, publish, releases, train_release
from tributary.operators.registry import REGISTRY, route_models
from tributary.operators.scoring import RiskModel, attach_call_log, forest_column, predict, prediction_rows, scorers
from tributary.operators.validate import check_events, quarantine_rows, valid_events
from tributary.session import dealt_by_rows, shared_folder, shuffled_by
from tributary.settings import DEFAULTS
from tributary.sources.tables import spread_partitions, table, wire_events
from tributary.streaming.stages import run_alerts, run_events, run_quarantine

# The tables hold one event per entity and hours: with a window of three days it holds several events.
WIDE = replace(DEFAULTS, window_ms=259_200_000)

# Fixed coefficients, so that scores do not depend on a fit; see the README on trained models.
FIXED_RISK = RiskModel(17.0, (0.02, -0.35, 0.18, 0.2, 0.01, 0.02))
FORESTS = ("anomaly_detector", "anomaly_detector_shadow")


def event_number(event_id: Column) -> Column:
    return F.regexp_extract(event_id, "([0-9]+)", 1).cast("bigint")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def source_state(spark: SparkSession, sf_dir: str) -> str:
    """The source with its files' sizes and times: a stage table is built anew when a file changes or is added."""
    jvm, found = spark._jvm, []
    for name in ("events", "customer"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):
            found += sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(path))
    return f"{sf_dir} {found}"


def stage_table(
    spark: SparkSession, sf_dir: str, stage: str, build: Callable[[], DataFrame], order: str | None = "arrival_time"
) -> DataFrame:
    """The stage as a written table of this session; built on first use, in tasks dealt by the rows of ``events``.

    Each file is sorted by time, so a report on the last minute or hour skips what is outside it. Tables that are only
    read whole have no ``order``.
    """
    key = (spark.sparkContext.applicationId, source_state(spark, sf_dir), stage)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/{key[0]}/{uuid.uuid4().hex}-{stage}"
        with dealt_by_rows(spark, spread_partitions(table(spark, sf_dir, "events"))):
            rows = build()
            (rows.sortWithinPartitions(order) if order else rows).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, so that accepted events and quarantine do not parse every message twice."""
    return stage_table(spark, sf_dir, "checked", lambda: check_events(wire_events(spark, sf_dir)), None)


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_events(checked(spark, sf_dir))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(spark, sf_dir, "quarantine", lambda: quarantine_rows(checked(spark, sf_dir)), "created_at")


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(spark, sf_dir, "accepted", lambda: dedup_events(valid(spark, sf_dir)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors; the payload is dropped, no later stage reads it."""
    return stage_table(
        spark,
        sf_dir,
        "vectors",
        lambda: feature_vectors(accepted(spark, sf_dir).drop("value"), WIDE).drop("attributes"),
    )


def with_fixed_raw(df: DataFrame) -> DataFrame:
    """A fixed formula in place of the trained forests' decision function."""
    hr = F.coalesce(F.col("features.heart_rate"), F.lit(80.0))
    spo2 = F.coalesce(F.col("features.spo2"), F.lit(98.0))
    raw = F.abs(hr - 80.0) * 0.004 + F.abs(spo2 - 98.0) * 0.02 - 0.15
    return df.withColumns({forest_column(name): raw for name in FORESTS})


def fixed_scorers():
    return scorers(FIXED_RISK, FORESTS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(with_fixed_raw(vectors(spark, sf_dir)), fixed_scorers())


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per accepted event and routed model, slow or failed by arithmetic on the event number."""
    calls = accepted(spark, sf_dir).select(
        "event_id", F.col("arrival_time").alias("called_at"), F.inline(route_models(F.col("event_type")))
    )
    n = event_number(F.col("event_id"))
    return calls.withColumns(
        {
            "latency_ms": ((n * 7 + F.col("position") * 31) % 260) + (n % 8) / F.lit(8.0),
            "failed": n % 53 == 0,
            "breaker_open": n % 211 == 0,
        }
    )


def vital_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter(F.col("event_type") == "patient_vital")


def model_folder(spark: SparkSession, sf_dir: str) -> str:
    """Two releases: one trained on the first half of the month and valid in it from the 8th, one on all, valid from the 16th."""
    key = (spark.sparkContext.applicationId, source_state(spark, sf_dir), "models")
    if key not in _WRITTEN:
        folder, rows = f"{shared_folder(spark)}/{key[0]}/{uuid.uuid4().hex}-models", vital_vectors(spark, sf_dir)
        begin, middle = (datetime(2024, 1, day, tzinfo=timezone.utc) for day in (8, 16))
        first = {m.name: m.version for m in REGISTRY.models if m.name in (*FORESTS, "risk_predictor")}
        publish(spark, folder, train_release(rows.filter(F.col("event_time") < F.lit(middle)), 1, begin, first))
        publish(spark, folder, train_release(rows, 2, middle, {name: f"{version}.r2" for name, version in first.items()}))
        _WRITTEN[key] = folder
    return _WRITTEN[key]


def trained_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on stored trained models, each event by the release valid at its time."""
    return stage_table(
        spark,
        sf_dir,
        "trained",
        lambda: decide(predict_released(vectors(spark, sf_dir), releases(spark, model_folder(spark, sf_dir)))),
        None,
    )


def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each call would end when the accepted events are replayed at one event number a second, with outages.

    Holds the routed calls and, where a model has a fallback, the call that would be made in its place.
    """
    n = event_number(F.col("event_id"))
    step = F.col("position")
    events = accepted(spark, sf_dir).select("event_id", "event_type")
    routed = events.select(
        "event_id",
        F.col("event_type"),
        F.timestamp_seconds(F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) + n).alias("called_at"),
        F.inline(route_models(F.col("event_type"))),
    )
    outage = (F.floor((n + step * 37) / 60) % 5 == 0) | (n % 53 == 0)
    slow = F.when((n + step) % 29 == 0, F.lit(200.0)).otherwise(F.lit(0.0))
    calls = routed.withColumns(
        {
            "latency_ms": ((n * 7 + step * 31) % 40).cast("double") + slow,
            "failed": outage,
            "fallback_for": F.lit(None).cast("string"),
        }
    )
    fallback = REGISTRY.lookup(F.col("model_name"), "fallback")
    instead = calls.filter(fallback.isNotNull()).withColumns(
        {
            "fallback_for": F.col("model_name"),
            "model_name": fallback,
            "latency_ms": (n % 70).cast("double"),
            "failed": F.floor(n / 20) % 3 == 0,
        }
    )
    columns = ["event_id", "model_name", "called_at", "latency_ms", "failed", "fallback_for"]
    return calls.select(*columns).unionByName(instead.select(*columns))


def replayed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay's calls under breakers with the default threshold and reset."""
    return stage_table(spark, sf_dir, "replayed", lambda: call_outcomes(replayed_log(spark, sf_dir)), None)


def scored_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = attach_call_log(vectors(spark, sf_dir), call_log(spark, sf_dir))
    return predict(with_fixed_raw(called), fixed_scorers())


def replayed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows of the replay: refused calls and failing fallbacks decide which models answer."""
    called = attach_call_log(vectors(spark, sf_dir), logged_calls(replayed_calls(spark, sf_dir)))
    return prediction_rows(predict(with_fixed_raw(called), fixed_scorers()))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table of the run whose calls are in the call log."""
    return stage_table(
        spark, sf_dir, "predictions", lambda: prediction_rows(scored_with_calls(spark, sf_dir)), "created_at"
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(spark, sf_dir, "decisions", lambda: decide(scored(spark, sf_dir)), "created_at")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(spark, sf_dir, "alerts", lambda: open_alerts(decisions(spark, sf_dir)), "created_at")


def commands(alert_table: DataFrame) -> DataFrame:
    """Acknowledge and resolve commands given to the alerts, by arithmetic on the event number."""
    n = event_number(F.col("event_id"))

    def command(step: int, kind: str, actor: str, after_s: int) -> Column:
        at = F.timestamp_micros(F.unix_micros("created_at") + F.lit(after_s * 1_000_000).cast("bigint"))
        return F.when(
            n % step == 0,
            F.struct(F.lit(kind).alias("command"), F.lit(actor).alias("actor"), at.alias("at"), F.lit(step).alias("step")),
        )

    given = F.array_compact(
        F.array(
            command(2, "ack", "ana", 60),
            command(4, "ack", "ben", 30),
            command(3, "resolve", "ana", 120),
            command(9, "resolve", "cho", 600),
            command(5, "ack", "dee", 300),
        )
    )
    return alert_table.select(F.col("id").alias("alert_id"), F.inline(given)).withColumn(
        "command_id", F.concat_ws("-", "alert_id", F.col("step").cast("string"))
    )


def written_folder(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """A folder that ``build`` fills once per session and state of the source."""
    key = (spark.sparkContext.applicationId, source_state(spark, sf_dir), name)
    if key not in _WRITTEN:
        folder = f"{shared_folder(spark)}/{key[0]}/{uuid.uuid4().hex}-{name}"
        build(folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


def write_lots(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The messages in three lots by the date in their timestamp, made once.

    Each lot has as many files as tasks made it, so the micro-batch that reads it is spread as well.
    """
    day = F.get_json_object("value", "$.timestamp")
    part = F.when(day < "2024-01-11", 0).when(day < "2024-01-21", 1).otherwise(2)
    wire_events(spark, sf_dir).withColumn("part", part).write.partitionBy("part").parquet(folder)


def stream_tables(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the tables the streams leave after all messages, run once per session.

    The messages come in three lots by the date in their timestamp, one micro-batch each, and the queries are started
    again for each from their checkpoints, so copies and history reach over micro-batches and restarts. The two queries on messages
    do not need each other and run side by side; state and shuffles are dealt by rows, as the messages are.
    """
    key = (spark.sparkContext.applicationId, source_state(spark, sf_dir), "streams")
    if key not in _WRITTEN:
        folder = f"{shared_folder(spark)}/{key[0]}/{uuid.uuid4().hex}-streams"
        write_lots(spark, sf_dir, f"{folder}/lots")
        with shuffled_by(spark, spread_partitions(table(spark, sf_dir, "events"))):
            for i in range(3):
                lot = spark.read.schema("value string, arrival_time timestamp").parquet(f"{folder}/lots/part={i}")
                lot.write.mode("append").parquet(f"{folder}/messages")
                raw = spark.readStream.schema("value string, arrival_time timestamp").parquet(f"{folder}/messages")
                refused = run_quarantine(raw, folder, f"{folder}/checkpoint-quarantine", WIDE)
                run_events(raw, folder, f"{folder}/checkpoint", fixed_scorers(), WIDE, with_fixed_raw).awaitTermination()
                refused.awaitTermination()
            run_alerts(spark, folder, f"{folder}/checkpoint-alerts", WIDE).awaitTermination()
        _WRITTEN[key] = folder
    return _WRITTEN[key]
