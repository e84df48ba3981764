"""The stages on streams.

``run_events`` takes raw messages to accepted events, feature vectors, predictions and decisions: earlier copies are known from keyed state,
the other batch operators run inside ``foreachBatch``. ``run_quarantine`` stores what validation refuses. Tables are laid out by day and
batch; a micro-batch that runs again replaces its own rows, so a restart repeats nothing. Looking back for history and alerts reads only
the days it needs. Rows are never dropped for being late, only flagged stale or refused by validation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from tributary.operators.alerts import after_commands, command_summary, open_alerts
from tributary.operators.decisions import decide
from tributary.operators.dedup import keep_first
from tributary.operators.features import feature_vectors
from tributary.operators.scoring import Scorers, predict, prediction_rows
from tributary.operators.validate import check_events, quarantine_rows, valid_events
from tributary.settings import DEFAULTS, Settings


def stream_validate(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Checked events; without state, so the batch operator as it is."""
    return check_events(raw, settings)


def stream_dedup(events: DataFrame) -> DataFrame:
    """One row per event id for ever: the first arrival (ties by source id) of the micro-batch that first holds the id.

    A micro-batch's copies meet by id, where the first is picked out of a partition's share of the batch; what is left is looked up in
    and added to the state, one short key per id. The state has no end of life, since an id may come again on any day; it lies in RocksDB and is
    read by key, so a batch costs the same however long the history. Rows without an id are one id.
    """
    order = ["event_id", "arrival_time", "source_id", "value"]

    def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # this partition's rows of this micro-batch
        if held:
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows.select(order), sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
            ids = rows["event_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            yield from rows.filter(pa.array(np.diff(ids, prepend=-1) != 0)).to_batches(max_chunksize=10_000)

    dealt = events.repartition("event_id")
    return dealt.mapInArrow(first_copies, events.schema).dropDuplicates(["event_id"])


def minute_rows(events: DataFrame, step: str | None = None) -> DataFrame:
    """Per minute (with ``step``, per sliding minute) and patient: events and stale events. Rows of several batches add up."""
    window = F.window("arrival_time", "1 minute", step) if step else F.window("arrival_time", "1 minute")
    late = F.unix_micros("arrival_time") - F.unix_micros("event_time") > DEFAULTS.lateness_s * 1_000_000
    counted = events.groupBy(window.alias("w"), "patient_id").agg(F.count("*").alias("events"), F.count_if(late).alias("stale"))
    return counted.select(F.col("w.start").alias("window_start"), "patient_id", "events", "stale")


def run_kpis(
    events: DataFrame, out: str, checkpoint: str, step: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Stores the minute rows of each micro-batch; a late event adds to its minute, whenever it comes."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        _store(minute_rows(rows, step), out, batch_id, "window_start")

    return _started(events, batch, checkpoint, trigger)


def kpis(spark: SparkSession, out: str) -> DataFrame:
    """Events, stale events and exact patients per minute, over all micro-batches so far."""
    by_patient = spark.read.parquet(out).groupBy("window_start", "patient_id").agg(
        F.sum("events").alias("events"), F.sum("stale").alias("stale")
    )
    return by_patient.groupBy("window_start").agg(
        F.sum("events").alias("events"), F.sum("stale").alias("stale"), F.count(F.nullif("patient_id", F.lit(""))).alias("patients")
    )


def _started(rows: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """``trigger`` as in ``DataStreamWriter.trigger``; by default all that is there, then the end."""
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _store(df: DataFrame, folder: str, batch_id: int, date_of: str) -> None:
    """Write a micro-batch's rows by day and batch; the same batch run again replaces its own rows only."""
    day = F.date_from_unix_date(F.floor(F.unix_millis(date_of) / 86_400_000).cast("int"))
    dated = df.withColumns({"day": day, "batch_id": F.lit(batch_id)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(
        folder
    )


def _stored(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows stored so far, with their day and batch; none before the first batch."""
    full = StructType([*schema.fields, StructField("day", DateType()), StructField("batch_id", IntegerType())])
    try:
        return spark.read.schema(full).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], full)
        raise


def _days(stored: DataFrame, first_ms: int, last_ms: int) -> DataFrame:
    """The stored rows of the days between two instants; a filter on the partition, so other days are not read."""
    first, last = (datetime.fromtimestamp(ms / 1000, timezone.utc).date() for ms in (first_ms, last_ms))
    return stored.filter(F.col("day").between(F.lit(first), F.lit(last)))


def new_vectors(new: DataFrame, stored: DataFrame, first_ms: int, last_ms: int, settings: Settings) -> DataFrame:
    """Feature vectors of new events, with the stored history of their patients inside the window."""
    patients = new.select("patient_id").filter(F.col("patient_id") != "").distinct()
    context = (
        stored.filter(F.col("event_time").between(*(F.timestamp_millis(F.lit(ms)) for ms in (first_ms - settings.window_ms, last_ms))))
        .join(patients, "patient_id", "left_semi")
        .select(*new.columns)
    )
    marked = new.withColumn("_new", F.lit(True)).unionByName(context.withColumn("_new", F.lit(False)))
    return feature_vectors(marked, settings).filter("_new").drop("_new")


def run_quarantine(
    raw: DataFrame, out: str, checkpoint: str, settings: Settings = DEFAULTS, trigger: dict | None = None
) -> StreamingQuery:
    """Raw messages to the table quarantine under ``out``; no state."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        _store(rows, f"{out}/quarantine", batch_id, "created_at")

    return _started(quarantine_rows(stream_validate(raw, settings)), batch, checkpoint, trigger)


def run_events(
    raw: DataFrame,
    out: str,
    checkpoint: str,
    scorers: Scorers,
    settings: Settings = DEFAULTS,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Raw messages to the tables accepted, vectors, predictions and decisions under ``out``.

    ``enrich`` adds columns the scorers need (the forests' decision function). The ids seen so far are the state in
    ``checkpoint``, which belongs to ``out``.
    """
    events = stream_dedup(valid_events(stream_validate(raw, settings)))
    spark, accepted = raw.sparkSession, f"{out}/accepted"  # a micro-batch's own session has no adaptive execution

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()  # the state is read and written once
        try:
            at_ms, came_ms = F.unix_millis("event_time"), F.unix_millis("arrival_time")
            first_ms, last_ms, came_first, came_last = rows.agg(
                F.min(at_ms), F.max(at_ms), F.min(came_ms), F.max(came_ms)
            ).first()
            if first_ms is None:
                return
            _store(rows, accepted, batch_id, "event_time")
        finally:
            rows.unpersist()

        def mine(table: str, schema: StructType, first: int, last: int) -> DataFrame:
            written = _days(_stored(spark, f"{out}/{table}", schema), first, last)
            return written.filter(F.col("batch_id") == batch_id).select(*schema.names)

        new = mine("accepted", events.schema, first_ms, last_ms)
        stored = _stored(spark, accepted, events.schema).filter(F.col("batch_id") < batch_id)
        stored = _days(stored, first_ms - settings.window_ms, last_ms)
        vectors = new_vectors(new, stored, first_ms, last_ms, settings).drop("attributes", "value")
        _store(vectors, f"{out}/vectors", batch_id, "event_time")
        vectors = mine("vectors", vectors.schema, first_ms, last_ms)
        made = decide(predict(vectors if enrich is None else enrich(vectors), scorers))
        _store(made, f"{out}/decisions", batch_id, "created_at")
        decided = mine("decisions", made.schema, came_first, came_last)
        _store(prediction_rows(decided), f"{out}/predictions", batch_id, "created_at")

    return _started(events, batch, checkpoint, trigger)


def run_alerts(
    spark: SparkSession, out: str, checkpoint: str, settings: Settings = DEFAULTS, schema=None, trigger: dict | None = None
) -> StreamingQuery:
    """Decisions table as a stream to the alerts table under ``out``: one alert per dedup key, the first processed.

    A key holds its bucket of time, so earlier alerts of the batch's keys are in the days of its own alerts: the look-up
    is exact however late a decision comes, and reads those days only.
    """
    decisions = spark.readStream.schema(schema or spark.read.parquet(f"{out}/decisions").schema).parquet(f"{out}/decisions")
    folder, bucket_ms = f"{out}/alerts", settings.alert_bucket_s * 1000

    def batch(rows: DataFrame, batch_id: int) -> None:
        alerts = open_alerts(rows, settings)
        first, last = rows.agg(F.min(F.unix_millis("created_at")), F.max(F.unix_millis("created_at"))).first()
        if first is None:
            return
        stored = _days(_stored(spark, folder, alerts.schema), first - bucket_ms, last + bucket_ms).filter(F.col("batch_id") < batch_id)
        _store(alerts.join(stored.select("dedup_key"), "dedup_key", "left_anti").select(*alerts.columns), folder, batch_id, "created_at")

    return _started(decisions.drop("batch_id", "day"), batch, checkpoint, trigger)


def stream_alert_lifecycle(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Each alert that a micro-batch touches, with its state after all rows so far (update mode).

    Alerts and commands are two streams that meet in one state per alert: its status (null until the alert itself has come), first ack,
    first and last resolve. All are a min or a max, so a command may come before its alert, and rows in any order over any micro-batches
    leave the state of the batch operator. Nothing is dropped for being late; the state is narrow and grows with the alerts.
    """
    command = {"command": "string", "actor": "string", "at": "timestamp", "command_id": "string"}
    raised = alerts.select(F.col("id"), "status", *[F.lit(None).cast(t).alias(c) for c, t in command.items()])
    given = commands.select(F.col("alert_id").alias("id"), F.lit(None).cast("string").alias("status"), *command)
    return raised.unionByName(given).groupBy("id").agg(F.max("status").alias("status"), *command_summary())


def run_alert_lifecycle(
    alerts: DataFrame, commands: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Stores what each micro-batch changed, a folder per batch; a batch that runs again replaces its own."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        changed = rows.withColumn("batch_id", F.lit(batch_id))
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    writer = stream_alert_lifecycle(alerts, commands).writeStream.outputMode("update").foreachBatch(batch)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def alert_states(spark: SparkSession, out: str) -> DataFrame:
    """``id`` and the lifecycle columns of every alert that has come, after all micro-batches so far: its last stored row."""
    last = keep_first(spark.read.parquet(out), ["id"], [F.col("batch_id").desc()])
    return after_commands(last.filter(F.col("status").isNotNull())).drop("batch_id")
