"""Deterministic rules and the decision per event.

A rule is a function without arguments that returns a struct (name, severity, reason, score) or
null; adding one to RULES needs no change elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import built_once, round_even, settled, stable_id
from tributary.operators.dedup import keep_first
from tributary.operators.registry import WEIGHTS
from tributary.operators.scoring import feature

# Severities from low to high, rule limits, actions and explanation texts.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SPO2_LIMIT, SPO2_CRITICAL = 92, 88
HR_LIMIT, HR_HIGH = 120, 140
RR_LIMIT = 26
OCCUPANCY_HIGH, OCCUPANCY_MEDIUM = 0.9, 0.8
IMAGING_WAIT = 90
MISSING_LIMIT, QUALITY_LIMIT = 0.66, 0.4
LOW_CONFIDENCE = 0.5
ESCALATE_HIGH, ESCALATE_MEDIUM = 0.85, 0.65
SAFE_ACTIONS = {
    "HIGH": "REVIEW_RECOMMENDED",
    "CRITICAL": "REVIEW_RECOMMENDED",
    "MEDIUM": "ANOMALY_DETECTED",
    "LOW": "MONITOR",
}
AI_NOTE = "probability / score of pattern being unusual — not a diagnosis"
RULES_NOTE = "deterministic thresholds on configured features"
FEATURES_SHOWN = ("heart_rate", "spo2", "respiratory_rate", "occupancy_ratio", "waiting_minutes")


def _hit(name: str, severity: Column | str, reason: Column | str, score: Column | float) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(name).alias("name"),
        as_col(severity).alias("severity"),
        as_col(reason).alias("reason"),
        as_col(score).alias("score"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def rule_low_spo2() -> Column:
    """The window's lowest SpO2, else the current one."""
    value = F.coalesce(feature("spo2_min_5m"), feature("spo2"))
    severity = F.when(value < SPO2_CRITICAL, "CRITICAL").otherwise("HIGH")
    return F.when(value < SPO2_LIMIT, _hit("low_spo2", severity, _text("SpO2 ", value, " below 92"), 0.9))


def rule_tachycardia() -> Column:
    hr = feature("heart_rate")
    severity = F.when(hr >= HR_HIGH, "HIGH").otherwise("MEDIUM")
    return F.when(hr >= HR_LIMIT, _hit("tachycardia", severity, _text("heart_rate ", hr, " >= 120"), 0.7))


def rule_high_respiratory_rate() -> Column:
    rr = feature("respiratory_rate")
    hit = _hit("high_respiratory_rate", "HIGH", _text("respiratory_rate ", rr, " >= 26"), 0.75)
    return F.when(rr >= RR_LIMIT, hit)


def rule_resource_congestion() -> Column:
    ratio = feature("occupancy_ratio")
    reason = F.concat(F.lit("occupancy "), F.format_string("%.2f", round_even(ratio, 2)))
    return F.when(ratio >= OCCUPANCY_HIGH, _hit("resource_congestion", "HIGH", reason, 0.8)).when(
        ratio >= OCCUPANCY_MEDIUM, _hit("resource_congestion", "MEDIUM", reason, 0.55)
    )


def rule_imaging_backlog() -> Column:
    wait = feature("waiting_minutes")
    return F.when(wait >= IMAGING_WAIT, _hit("imaging_backlog", "HIGH", _text("imaging wait ", wait, "m"), 0.7))


def rule_data_quality() -> Column:
    """Many missing vitals, or the quality model's score whatever its status."""
    flagged = F.exists(
        "predictions",
        lambda p: (p["model_name"] == "data_quality_scorer") & (F.coalesce(p["score"], F.lit(0.0)) >= QUALITY_LIMIT),
    )
    missing = F.coalesce(feature("missing_ratio"), F.lit(0.0)) >= MISSING_LIMIT
    reason = F.when(missing, "high missingness").otherwise("model flagged data quality")
    return F.when(missing | flagged, _hit("data_quality_issue", "LOW", reason, 0.4))


def rule_model_confidence() -> Column:
    usable = F.filter("predictions", lambda p: (p["status"] == "success") & ~p["shadow"])
    low = F.forall(usable, lambda p: F.coalesce(p["confidence"], F.lit(0.0)) < LOW_CONFIDENCE)
    reason = F.when(F.size(usable) == 0, "no successful primary predictions").otherwise("all model confidences low")
    return F.when(low, _hit("model_confidence_low", "LOW", reason, 0.3))


RULES: tuple[Callable[[], Column], ...] = (
    rule_low_spo2,
    rule_tachycardia,
    rule_high_respiratory_rate,
    rule_resource_congestion,
    rule_imaging_backlog,
    rule_data_quality,
    rule_model_confidence,
)


@built_once
def triggered_rules() -> Column:
    """Fired rules in rule order."""
    return F.array_compact(F.array(*[rule() for rule in RULES]))


def _rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def max_severity(fired: Column) -> Column:
    highest = F.array_max(F.transform(fired, lambda r: _rank(r["severity"])))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.coalesce(highest, F.lit(1)).cast("int"))


@built_once
def _primary_score(name: str) -> Column:
    """Score of the first successful (or fallback) non-shadow prediction of a model; 0 when there is none."""
    found = F.filter("_primary", lambda p: p["model_name"] == name)
    return F.coalesce(F.get(found, 0)["score"], F.lit(0.0))


@built_once
def _final_action() -> Column:
    return action_for(F.col("severity"), F.col("_names"), F.col("event_type"))


@built_once
def _rounded(name: str) -> Column:
    return round_even(F.col(name), 4)


def _with_components(scored: DataFrame) -> DataFrame:
    fired = scored.withColumns(
        {
            "_fired": triggered_rules(),
            "_primary": F.filter("predictions", lambda p: p["status"].isin("success", "fallback") & ~p["shadow"]),
        }
    )
    anomaly = _primary_score("anomaly_detector")
    return fired.withColumns(
        {
            "_anomaly": F.when(anomaly == 0, _primary_score("threshold_detector")).otherwise(anomaly),
            "_risk": _primary_score("risk_predictor"),
            "_capacity": _primary_score("capacity_forecaster"),
            "_imaging": _primary_score("imaging_prioritizer"),
            "_rule": F.coalesce(F.array_max(F.transform("_fired", lambda r: r["score"])), F.lit(0.0)),
            "_severity": max_severity(F.col("_fired")),
            "_names": F.transform("_fired", lambda r: r["name"]),
        }
    )


@built_once
def decision_score() -> Column:
    """Weighted score; bed and imaging events use their own model instead."""
    weighted = (
        F.col("_anomaly") * WEIGHTS["anomaly_detector"]
        + F.col("_risk") * WEIGHTS["risk_predictor"]
        + F.col("_rule") * WEIGHTS["rules"]
    )
    return (
        F.when(F.col("event_type") == "bed_status", F.col("_capacity") * 0.7 + F.col("_rule") * 0.3)
        .when(F.col("event_type") == "imaging_request", F.col("_imaging") * 0.7 + F.col("_rule") * 0.3)
        .otherwise(weighted)
    )


def escalate(severity: Column, score: Column) -> Column:
    """The unrounded score can raise the severity."""
    return (
        F.when((score >= ESCALATE_HIGH) & severity.isin("LOW", "MEDIUM"), "HIGH")
        .when((score >= ESCALATE_MEDIUM) & (score < ESCALATE_HIGH) & (severity == "LOW"), "MEDIUM")
        .otherwise(severity)
    )


@built_once
def decision_confidence() -> Column:
    known = F.filter(F.transform("_primary", lambda p: p["confidence"]), lambda c: c.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, c: acc + c)
    return F.when(F.size(known) > 0, total / F.size(known)).otherwise(F.lit(0.5))


def action_for(severity: Column, names: Column, event_type: Column) -> Column:
    """The first matching case decides."""
    fired = lambda name: F.array_contains(names, name)
    safe = F.create_map(*[F.lit(x) for pair in SAFE_ACTIONS.items() for x in pair])
    return (
        F.when(fired("resource_congestion"), "RESOURCE_CONGESTION")
        .when(fired("data_quality_issue") & (severity == "LOW"), "DATA_QUALITY_ISSUE")
        .when(fired("model_confidence_low") & (F.size(names) == 1), "MODEL_CONFIDENCE_LOW")
        .when(fired("imaging_backlog"), "REVIEW_RECOMMENDED")
        .when((event_type == "patient_vital") & (severity == "MEDIUM"), "ANOMALY_DETECTED")
        .when((event_type == "patient_vital") & severity.isin("HIGH", "CRITICAL"), "REVIEW_RECOMMENDED")
        .otherwise(F.element_at(safe, severity))
    )


@built_once
def explanation() -> Column:
    return F.struct(
        F.lit(AI_NOTE).alias("ai"),
        F.lit(RULES_NOTE).alias("rules"),
        F.col("_names").alias("triggered_rules"),
        F.filter(F.transform("_fired", lambda r: r["reason"]), lambda x: x != "").alias("rule_reasons"),
        F.struct(*[F.lit(w).alias(name) for name, w in WEIGHTS.items()]).alias("weights"),
        F.struct(
            F.col("_anomaly").alias("anomaly"), F.col("_risk").alias("risk"), F.col("_rule").alias("rules")
        ).alias("components"),
        F.struct(*[feature(name).alias(name) for name in FEATURES_SHOWN]).alias("features_used"),
        F.exists("predictions", lambda p: p["status"].isin("timeout", "error", "circuit_open")).alias("partial"),
        F.transform(F.filter("predictions", lambda p: p["shadow"]), lambda p: p["model_name"]).alias("shadow_models"),
    )


def decide(scored: DataFrame) -> DataFrame:
    """One decision per scored event; row-local, so it runs unchanged on a stream."""
    parts = _with_components(scored).withColumns({"_score": decision_score(), "_confidence": decision_confidence()})
    judged = parts.withColumn("severity", escalate(F.col("_severity"), F.col("_score")))
    rows = judged.select(
        stable_id("decision", F.col("event_id")).alias("id"),
        "event_id",
        "event_type",
        "patient_id",
        "resource_id",
        "source_id",
        "severity",
        _final_action().alias("action"),
        _rounded("_score").alias("decision_score"),
        _rounded("_confidence").alias("confidence"),
        F.col("_names").alias("triggered_rules"),
        "predictions",
        explanation().alias("explanation"),
        "trace_id",
        "arrival_time",
        F.col("arrival_time").alias("created_at"),
    )
    return settled(rows)


def dedup_decisions(decisions: DataFrame) -> DataFrame:
    """One stored decision per event: the first."""
    return keep_first(decisions, ["event_id"], [F.col("created_at"), F.col("id")])
