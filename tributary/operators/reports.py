"""Operational queries over the stage tables: KPIs, timelines, lists and model statistics.

Every "now" is an explicit ``as_of``, so a query gives the same answer when it runs again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.columns import round_even
from tributary.operators.registry import REGISTRY, Registry
from tributary.settings import DEFAULTS, Settings

# States that count as open, and the quantile shown per model.
OPEN_STATES = ("OPEN", "CREATED")
MODEL_QUANTILE = 0.95


def _newest(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Top rows by a total order (TakeOrderedAndProject: each task keeps ``limit`` rows)."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def event_summary(events: DataFrame, status: DataFrame, predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every event with its status, number of predictions and decision.

    Predictions are counted per event before the join, so the join is one row to one row.
    """
    counts = predictions.groupBy("event_id").agg(F.count("*").alias("prediction_count"))
    made = decisions.select("event_id", F.col("id").alias("decision_id"), "severity", "action")
    return (
        events.join(status, "event_id", "left")
        .join(counts, "event_id", "left")
        .join(made, "event_id", "left")
        .select(
            "event_id",
            "status",
            "event_type",
            "patient_id",
            F.col("event_time").alias("timestamp"),
            F.coalesce("prediction_count", F.lit(0).cast("bigint")).alias("prediction_count"),
            "decision_id",
            "severity",
            "action",
            "trace_id",
            F.col("value").alias("payload"),
        )
    )


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    shown = events.select("event_id", "event_type", "patient_id", "event_time", "arrival_time", "trace_id")
    return _newest(shown, [F.col("arrival_time").desc(), F.col("event_id").desc()], limit)


def patient_timeline(
    events: DataFrame,
    alerts: DataFrame,
    decisions: DataFrame,
    patients: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    severity: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Newest events, alerts and decisions of every patient, ``limit`` of each kind.

    The rank filter cuts each patient's rows inside every map task before the shuffle, so a patient
    with a third of all events sends ``limit`` rows per task. Names are joined after the cut.
    """
    has_patient = F.coalesce(F.col("patient_id"), F.lit("")) != ""

    def rows(df: DataFrame, kind: str, ref: str, at: str, detail: Column, level: Column) -> DataFrame:
        return df.filter(has_patient).select(
            "patient_id",
            F.lit(kind).alias("kind"),
            F.col(ref).alias("ref"),
            F.col(at).alias("at"),
            detail.alias("detail"),
            level.alias("severity"),
        )

    seen = events
    if start is not None:
        seen = seen.filter(F.col("event_time") >= start)
    if end is not None:
        seen = seen.filter(F.col("event_time") <= end)
    raised = alerts if severity is None else alerts.filter(F.col("severity") == severity)
    none = F.lit(None).cast("string")
    kinds = [
        rows(seen, "event", "event_id", "event_time", F.col("event_type"), none),
        rows(raised, "alert", "id", "created_at", F.col("alert_type"), F.col("severity")),
        rows(decisions, "decision", "id", "created_at", F.col("action"), F.col("severity")),
    ]
    window = Window.partitionBy("patient_id").orderBy(F.col("at").desc(), F.col("ref").desc())
    cut = [k.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= limit) for k in kinds]
    union = reduce(DataFrame.unionByName, cut)
    names = patients.select(F.col("external_ref").alias("patient_id"), "display_name", "ward_id")
    return union.join(names, "patient_id", "left").withColumn(
        "display_name", F.coalesce("display_name", "patient_id")
    )


def list_alerts(
    alerts: DataFrame,
    patient_id: str | None = None,
    severity: str | None = None,
    status: str | None = None,
    alert_type: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    limit: int | None = 50,
) -> DataFrame:
    wanted = {"patient_id": patient_id, "severity": severity, "status": status, "alert_type": alert_type}
    for name, value in wanted.items():
        if value:
            alerts = alerts.filter(F.col(name) == value)
    if start is not None:
        alerts = alerts.filter(F.col("created_at") >= start)
    if end is not None:
        alerts = alerts.filter(F.col("created_at") <= end)
    return _newest(alerts, [F.col("created_at").desc(), F.col("id").desc()], limit)


def list_quarantine(quarantine: DataFrame, limit: int = 50) -> DataFrame:
    return _newest(quarantine, [F.col("created_at").desc(), F.col("id").desc()], limit)


def recent_audit(audit: DataFrame, limit: int = 100) -> DataFrame:
    return _newest(audit, [F.col("created_at").desc(), F.col("id").desc()], limit)


def list_patients(patients: DataFrame) -> DataFrame:
    return patients.orderBy("external_ref")


def alert_feed(alerts: DataFrame, n: int = 40) -> DataFrame:
    """Newest alert messages of the live feed."""
    shown = alerts.select("id", "severity", "alert_type", "message", "created_at")
    return _newest(shown, [F.col("created_at").desc(), F.col("id").desc()], n)


def _since(as_of: Column, interval: str) -> Column:
    return F.col("arrival_time").between(as_of - F.expr(f"interval {interval}"), as_of)


def kpi_events_per_min(events: DataFrame, as_of: Column) -> DataFrame:
    return events.filter(_since(as_of, "1 minute")).agg(F.count("*").alias("events_per_min"))


def kpi_active_patients(events: DataFrame, as_of: Column, approximate: bool = False) -> DataFrame:
    """Distinct patients of the last hour, exact unless asked otherwise."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return events.filter(_since(as_of, "1 hour")).agg(count("patient_id").alias("active_patients"))


def kpi_open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status").isin(*OPEN_STATES)).agg(F.count("*").alias("open_alerts"))


def kpi_model_success_rate(predictions: DataFrame) -> DataFrame:
    """Successes over all predictions; 1 when there are none."""
    rate = predictions.agg(
        F.count_if(F.col("status") == "success").alias("ok"), F.count("*").alias("n")
    ).select(F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("ok") / F.col("n")).alias("rate"))
    return rate.select(round_even(F.col("rate"), 4).alias("model_success_rate"))


def kpi_alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status").isin(*OPEN_STATES)).groupBy("severity").agg(F.count("*").alias("alerts"))


def overview(events: DataFrame, alerts: DataFrame, predictions: DataFrame, as_of: Column) -> DataFrame:
    """All KPIs in one row: each KPI becomes (name, key, value) rows, folded by one small aggregation."""

    def named(df: DataFrame, name: str, value: str, key: str | None = None) -> DataFrame:
        return df.select(
            F.lit(name).alias("name"),
            (F.col(key) if key else F.lit("")).alias("key"),
            F.col(value).cast("double").alias("value"),
        )

    parts = [
        named(kpi_events_per_min(events, as_of), "events_per_min", "events_per_min"),
        named(kpi_active_patients(events, as_of), "active_patients", "active_patients"),
        named(kpi_open_alerts(alerts), "open_alerts", "open_alerts"),
        named(kpi_model_success_rate(predictions), "model_success_rate", "model_success_rate"),
        named(kpi_alerts_by_severity(alerts), "alerts_by_severity", "alerts", "severity"),
    ]
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    # At most one entry per severity is collected.
    by_severity = F.collect_list(
        F.when(F.col("name") == "alerts_by_severity", F.struct("key", F.col("value").cast("bigint").alias("value")))
    )
    return reduce(DataFrame.unionByName, parts).agg(
        pick("events_per_min").cast("bigint").alias("events_per_min"),
        pick("active_patients").cast("bigint").alias("active_patients"),
        pick("open_alerts").cast("bigint").alias("open_alerts"),
        pick("model_success_rate").alias("model_success_rate"),
        F.map_from_entries(F.array_sort(by_severity)).alias("alerts_by_severity"),
    )


def _reach(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``counts`` whose running count first passes the wanted position (column ``_position``).

    Leaves the position relative to the chosen row's own members, for a finer pass.
    """
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    passed = counts.withColumn("_upto", F.sum("_count").over(running))
    return passed.filter(
        (F.col("_position") < F.col("_upto")) & (F.col("_position") >= F.col("_upto") - F.col("_count"))
    ).withColumn("_position", F.col("_position") - (F.col("_upto") - F.col("_count")))


def quantile_by_position(
    df: DataFrame, keys: list[str], value: str, q: float, widths: tuple[float, ...] = (1.0, 0.001), upper: bool = False
) -> DataFrame:
    """Per key the value at sorted position floor(q * (n - 1)), or its ceiling with ``upper``; exact.

    Few keys with very many rows must not be sorted in one task each. Equal values are counted
    first; each pass then counts per bucket of a finer width, finds the bucket that holds the
    position, and only that bucket's values go on. The windows see buckets, never rows.
    """
    counted = df.groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_count"))
    sizes = counted.groupBy(*keys).agg(F.sum("_count").alias("_n"))
    position = F.lit(q) * (F.col("_n") - 1)
    position = F.ceil(position) if upper else F.floor(position)
    targets = sizes.select(*keys, position.cast("bigint").alias("_position"))
    left = counted
    for i, width in enumerate(widths):
        bucket = f"_bucket{i}"
        left = left.withColumn(bucket, F.floor(F.col("_value") / F.lit(width)))
        per_bucket = left.groupBy(*keys, bucket).agg(F.sum("_count").alias("_count"))
        chosen = _reach(per_bucket.join(targets, keys), keys, bucket)
        targets = chosen.select(*keys, F.col(bucket).alias("_wanted"), "_position")
        # One target row per key comes back to the counts: cut them to the wanted bucket.
        left = left.join(targets.drop("_position"), keys).filter(F.col(bucket) == F.col("_wanted")).drop("_wanted")
        targets = targets.drop("_wanted")
    return _reach(left.join(targets, keys), keys, "_value").select(*keys, F.col("_value").alias(value))


def model_stats(predictions: DataFrame) -> DataFrame:
    """Per model and version: rows, success rate, and the latency at position floor(.95 * (n - 1))."""
    keys = ["model_name", "model_version"]
    rows = predictions.select(*keys, "status", F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"))
    rates = rows.groupBy(*keys).agg(
        F.count("*").alias("count"), F.count_if(F.col("status") == "success").alias("_ok")
    )
    p95 = quantile_by_position(rows, keys, "latency_ms", MODEL_QUANTILE)
    joined = rates.join(p95, keys).withColumn("_rate", F.col("_ok") / F.col("count"))
    return joined.select(
        *keys,
        "count",
        round_even(F.col("_rate"), 4).alias("success_rate"),
        round_even(F.col("latency_ms"), 2).alias("p95_ms"),
    )


def call_attempts(predictions: DataFrame) -> DataFrame:
    """Attempts behind prediction rows: the row's own call, and the failed primary it replaced.

    A call refused by an open breaker is no attempt.
    """
    own = F.struct(
        F.col("model_name").alias("model_name"),
        F.col("status").isin("success", "shadow", "fallback").alias("ok"),
        F.col("status").alias("outcome"),
    )
    replaced = F.when(
        F.col("fallback_for").isNotNull(),
        F.struct(
            F.col("fallback_for").alias("model_name"), F.lit(False).alias("ok"), F.col("primary_status").alias("outcome")
        ),
    )
    rows = predictions.select(
        "event_id", F.col("created_at").alias("at"), F.explode(F.array_compact(F.array(own, replaced))).alias("a")
    )
    return rows.select("event_id", "at", "a.*").filter(F.col("outcome") != "circuit_open").drop("outcome")


def breaker_state(
    attempts: DataFrame, as_of: Column, settings: Settings = DEFAULTS, registry: Registry = REGISTRY
) -> DataFrame:
    """Breaker per registered model at ``as_of``, from its attempts (``model_name``, ``ok``, ``at``, ``event_id``).

    Only a success resets the failure count, so the state follows from the failures after the last
    success. The last success per model is one row per registered model (the registry is a literal
    table), small enough to broadcast back to the attempts.
    """
    names = [m.name for m in registry.models]
    known = attempts.filter(F.col("model_name").isin(*names) & (F.col("at") <= as_of))
    order = F.struct("at", "event_id")
    last = known.groupBy("model_name").agg(F.max(F.when(F.col("ok"), order)).alias("_last_ok"))
    after = F.col("_last_ok").isNull() | (order > F.col("_last_ok"))
    failed = known.join(F.broadcast(last), "model_name").groupBy("model_name").agg(
        F.count_if(~F.col("ok") & after).alias("failures"),
        F.max(F.when(~F.col("ok") & after, F.col("at"))).alias("_last_failure"),
    )
    is_open = F.col("failures") >= settings.breaker_threshold
    cooled = F.col("_last_failure") <= as_of - F.expr(f"interval {settings.breaker_reset_s} seconds")
    return failed.select(
        "model_name",
        "failures",
        F.when(is_open, F.col("_last_failure")).alias("opened_at"),
        F.when(is_open & cooled, "HALF_OPEN").when(is_open, "OPEN").otherwise("CLOSED").alias("state"),
    )


def model_panel(stats: DataFrame, breakers: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Registry with statistics and breaker state; the registry side is a literal table."""
    spark = stats.sparkSession
    rows = [
        (m.name, m.version, "shadow" if m.shadow else f"fallback: {m.fallback}" if m.fallback else "primary", m.timeout_ms)
        for m in registry.models
    ]
    base = spark.createDataFrame(rows, "model_name string, model_version string, mode string, timeout_ms int")
    return (
        base.join(stats, ["model_name", "model_version"], "left")
        .join(breakers.select("model_name", "state"), "model_name", "left")
        .withColumn("state", F.coalesce("state", F.lit("CLOSED")))
    )


