"""Alerts from decisions: silence, deduplication, rows, outbox, audit and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import built_once, first_non_blank, round_even, stable_id
from tributary.operators.dedup import keep_first
from tributary.settings import DEFAULTS, Settings

# Actions that open no alert, the message tail, actors and audit actions.
SILENT_ACTIONS = ("MONITOR",)
MESSAGE_TAIL = "Synthetic data; not a clinical diagnosis."
INGESTION, ALERTING = "ingestion", "alert-service"
VALIDATED, CREATED = "EVENT_VALIDATED", "ALERT_CREATED"
ACKNOWLEDGED, RESOLVED = "ALERT_ACKNOWLEDGED", "ALERT_RESOLVED"


def alert_candidates(decisions: DataFrame) -> DataFrame:
    quiet = F.col("action").isin(*SILENT_ACTIONS) & (F.col("severity") == "LOW")
    return decisions.filter(~quiet)


def alert_entity() -> Column:
    return first_non_blank(F.col("patient_id"), F.col("resource_id"), F.col("source_id"))


def dedup_key(settings: Settings = DEFAULTS) -> Column:
    """Entity, action and the bucket of processing time."""
    bucket = F.floor(F.unix_micros("created_at") / F.lit(settings.alert_bucket_s * 1_000_000))
    return F.concat_ws(":", alert_entity(), F.col("action"), bucket.cast("string"))


def alert_dedup(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """First candidate per dedup key; the bucket is part of the key, so this is exact."""
    keyed = candidates.withColumn("dedup_key", dedup_key(settings))
    return keep_first(keyed, ["dedup_key"], [F.col("created_at"), F.col("event_id")])


@built_once
def alert_message() -> Column:
    rules = F.when(F.size("triggered_rules") > 0, F.array_join("triggered_rules", ", ")).otherwise("model scores")
    who = F.coalesce(F.nullif(F.col("patient_id"), F.lit("")), F.lit("resource"))
    score = F.format_string("%.2f", round_even(F.col("decision_score"), 2))
    return F.concat(
        F.col("action"),
        F.lit(" ("),
        F.col("severity"),
        F.lit(") for "),
        who,
        F.lit(" — score="),
        score,
        F.lit(", rules=["),
        rules,
        F.lit(f"]. {MESSAGE_TAIL}"),
    )


def alert_rows(kept: DataFrame) -> DataFrame:
    """Alert table rows from deduplicated candidates."""
    return kept.select(
        stable_id("alert", F.col("dedup_key")).alias("id"),
        "event_id",
        "patient_id",
        F.col("action").alias("alert_type"),
        "severity",
        F.lit("OPEN").alias("status"),
        alert_message().alias("message"),
        "dedup_key",
        "explanation",
        "trace_id",
        "arrival_time",
        "created_at",
    )


def open_alerts(decisions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return alert_rows(alert_dedup(alert_candidates(decisions), settings))


def alert_outbox(alerts: DataFrame) -> DataFrame:
    """Outbox envelope per alert, written already marked as published."""
    payload = F.struct(
        "id",
        "patient_id",
        "event_id",
        "alert_type",
        "severity",
        "status",
        "message",
        "explanation",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created_at"),
    )
    return alerts.select(
        stable_id("outbox", F.col("id")).alias("id"),
        F.col("id").alias("aggregate_id"),
        F.lit(CREATED).alias("event_type"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
        F.lit(True).alias("published"),
        "created_at",
    )


def command_summary() -> list[Column]:
    """Aggregates of one alert's commands: the first ack, the first and the last resolve.

    Commands (``command``, ``actor``, ``at``, ``command_id``) shrink before the shuffle: each is a min or a max, so
    their order of coming does not matter and a stream can keep them as state.
    """
    order = F.struct("at", "command_id")
    is_ack, is_resolve = F.col("command") == "ack", F.col("command") == "resolve"
    return [
        F.min(F.when(is_ack, F.struct("at", "command_id", "actor"))).alias("_ack"),
        F.min(F.when(is_resolve, order)).alias("_first_resolve"),
        F.max(F.when(is_resolve, order)).alias("_last_resolve"),
    ]


def alert_lifecycle(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Alerts after their commands.

    Only an open alert can be acknowledged, and the first acknowledgement wins; a resolve works in
    any state, and the last sets the time. The first ack of all counts exactly when it precedes the
    first resolve.
    """
    summary = commands.groupBy(F.col("alert_id").alias("id")).agg(*command_summary())
    return after_commands(alerts.join(summary, "id", "left"))


def after_commands(joined: DataFrame) -> DataFrame:
    """Alerts (at least their ``status``) with the columns of ``command_summary``, which become the lifecycle columns."""
    ack_key = F.struct(F.col("_ack.at"), F.col("_ack.command_id"))
    acked = F.col("_ack").isNotNull() & (F.col("_first_resolve").isNull() | (ack_key < F.col("_first_resolve")))
    resolved = F.col("_last_resolve").isNotNull()
    openable = F.col("status").isin("OPEN", "CREATED")
    return joined.withColumns(
        {
            "acknowledged_at": F.when(acked & openable, F.col("_ack.at")),
            "acknowledged_by": F.when(acked & openable, F.col("_ack.actor")),
            "resolved_at": F.col("_last_resolve.at"),
            "status": F.when(resolved, "RESOLVED")
            .when(acked & openable, "ACKNOWLEDGED")
            .otherwise(F.col("status")),
        }
    ).drop("_ack", "_first_resolve", "_last_resolve")


def _audit(
    df: DataFrame, trace: Column, actor: Column | str, action: str, kind: str, resource: Column, at: Column, meta=None, command=()
) -> DataFrame:
    """``command`` holds the id of the row's own command, where several may meet in one instant."""
    return df.select(
        stable_id("audit", F.lit(action), resource, F.unix_micros(at).cast("string"), *command).alias("id"),
        trace.alias("trace_id"),
        (F.lit(actor) if isinstance(actor, str) else actor).alias("actor"),
        F.lit(action).alias("action"),
        F.lit(kind).alias("resource_type"),
        resource.alias("resource_id"),
        (F.lit(None).cast("map<string,string>") if meta is None else meta).alias("metadata"),
        at.alias("created_at"),
    )


def validation_audit(events: DataFrame) -> DataFrame:
    return _audit(
        events, F.col("trace_id"), INGESTION, VALIDATED, "event", F.col("event_id"), F.col("arrival_time")
    )


def audit_trail(events: DataFrame, alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """All audit rows: accepted events, alerts, real acknowledgements, every resolve."""
    described = F.create_map(F.lit("severity"), F.col("severity"), F.lit("type"), F.col("alert_type"))
    created = _audit(
        alerts, F.col("trace_id"), ALERTING, CREATED, "alert", F.col("id"), F.col("created_at"), described
    )
    after = alert_lifecycle(alerts, commands).filter(F.col("acknowledged_at").isNotNull())
    acked = _audit(
        after,
        F.col("event_id"),
        F.col("acknowledged_by"),
        ACKNOWLEDGED,
        "alert",
        F.col("id"),
        F.col("acknowledged_at"),
        F.create_map(F.lit("severity"), F.col("severity")),
    )
    resolves = commands.filter(F.col("command") == "resolve").join(
        alerts.select(F.col("id").alias("alert_id"), "event_id"), "alert_id"
    )
    resolved = _audit(
        resolves, F.col("event_id"), F.col("actor"), RESOLVED, "alert", F.col("alert_id"), F.col("at"), None, [F.col("command_id")]
    )
    return validation_audit(events).unionByName(created).unionByName(acked).unionByName(resolved)


# Processing states from first to last.
STATES = ("VALIDATING", "FEATURE_EXTRACTION", "INFERENCE", "PARTIAL_SUCCESS", "DECISION", "COMPLETED")


def processing_status(
    events: DataFrame, vectors: DataFrame, scored: DataFrame, predictions: DataFrame, decisions: DataFrame, finished: DataFrame
) -> DataFrame:
    """Furthest stage per accepted event, from the ids present in each stage table; ``predictions`` tell which were cut short.

    The stages are unioned with the number of their state and reduced per event by one maximum,
    combined before the only shuffle, in place of a chain of joins.
    """

    def reached(df: DataFrame, state: str) -> DataFrame:
        return df.select("event_id", F.array_position(states, F.lit(state)).cast("int").alias("state"))

    states = F.array(*[F.lit(s) for s in STATES])
    stages = (
        reached(events, "VALIDATING")
        .unionByName(reached(vectors, "FEATURE_EXTRACTION"))
        .unionByName(reached(scored, "INFERENCE"))
        .unionByName(reached(predictions.filter(F.col("status").isin("timeout", "error")), "PARTIAL_SUCCESS"))
        .unionByName(reached(decisions, "DECISION"))
        .unionByName(reached(finished, "COMPLETED"))
    )
    furthest = stages.groupBy("event_id").agg(F.max("state").alias("state"))
    return furthest.select("event_id", F.element_at(states, F.col("state")).alias("status"))
