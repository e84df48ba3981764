"""Model scores as column expressions, call outcomes, fallbacks and the predictions of an event.

All models routed to an event are evaluated in one projection; only the isolation forest's path
length needs an Arrow function, applied beforehand (``forest.py``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import built_once, capped, flag_number, number, settled, sigmoid, stable_id
from tributary.operators.registry import FALLBACK_TIMEOUT_MS, REGISTRY, Model, Registry, model_hash

# Cut-offs, weights, confidences and input defaults of the built-in scorers.
HR_HIGH, HR_LOW, SPO2_LOW, RR_HIGH = 120, 45, 92, 26
FOREST_INPUTS = (
    ("heart_rate", 80.0),
    ("spo2", 98.0),
    ("respiratory_rate", 16.0),
    ("heart_rate_mean_5m", None),
    ("spo2_delta_5m", 0.0),
    ("hr_variance_5m", 4.0),
)
RISK_INPUTS = (
    ("heart_rate", 80.0),
    ("spo2", 98.0),
    ("respiratory_rate", 16.0),
    ("temperature_c", 36.8),
    ("systolic_bp", 120.0),
    ("heart_rate_mean_15m", None),
)
PREDICTION_TYPE = (
    "struct<model_name:string,model_version:string,model_hash:string,score:double,label:string,"
    "confidence:double,latency_ms:double,status:string,shadow:boolean,explanation:map<string,string>,"
    "fallback_for:string,primary_status:string>"
)
CALL_TYPE = "map<string,struct<latency_ms:double,failed:boolean,breaker_open:boolean>>"


@dataclass(frozen=True)
class RiskModel:
    """Logistic regression: intercept and one weight per entry of RISK_INPUTS."""

    intercept: float
    weights: tuple[float, ...]


def feature(name: str) -> Column:
    return F.col(f"features.{name}")


def model_inputs(inputs: tuple[tuple[str, float | None], ...]) -> list[Column]:
    """Model inputs with defaults; a mean without its own default falls back to the heart rate.

    ``heart_rate_mean_15m`` is an input no feature provides, so it always is the heart rate.
    """
    heart_rate = number(feature("heart_rate"), 80.0)
    cols = []
    for name, default in inputs:
        if default is not None:
            cols.append(number(feature(name), default))
        elif name == "heart_rate_mean_15m":
            cols.append(heart_rate)
        else:
            cols.append(F.coalesce(feature(name).cast("double"), heart_rate))
    return cols


def _score(score: Column, label: Column, confidence: Column | float, **explanation: Column) -> Column:
    entries = [x for key, value in explanation.items() for x in (F.lit(key), value.cast("string"))]
    note = F.create_map(*entries) if entries else F.expr("cast(map() as map<string,string>)")
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(
        score.cast("double").alias("score"),
        label.alias("label"),
        confidence.alias("confidence"),
        note.alias("explanation"),
    )


def score_threshold() -> Column:
    """Counts the vitals beyond their limits."""
    hr, spo2, rr = feature("heart_rate"), feature("spo2"), feature("respiratory_rate")
    reasons = F.array_compact(
        F.array(
            F.when((hr > HR_HIGH) | (hr < HR_LOW), "hr_threshold"),
            F.when(spo2 < SPO2_LOW, "spo2_threshold"),
            F.when(rr > RR_HIGH, "rr_threshold"),
        )
    )
    hits = F.size(reasons)
    return _score(
        capped(hits / F.lit(3.0) + F.when(hits > 0, F.lit(0.35)).otherwise(F.lit(0.05))),
        F.when(hits > 0, "anomalous").otherwise("nominal"),
        F.when(hits > 0, F.lit(0.7)).otherwise(F.lit(0.55)),
        reasons=F.array_join(reasons, ","),
    )


def score_capacity() -> Column:
    ratio = number(feature("occupancy_ratio"), 0.5)
    score = capped(ratio * 1.05 + F.lit(0.05) * number(feature("occupied_count"), 0) / 20.0)
    return _score(score, F.when(score >= 0.85, "congestion").otherwise("stable"), 0.8, occupancy_ratio=ratio)


def score_imaging() -> Column:
    wait = number(feature("waiting_minutes"), 0)
    acuity = number(feature("acuity_code"), 2)
    modality = number(feature("modality_code"), 2)
    score = capped(wait / 180.0 * 0.5 + acuity / 3.0 * 0.35 + modality / 5.0 * 0.15)
    return _score(score, F.when(score >= 0.6, "prioritize").otherwise("routine"), 0.75, wait=wait, acuity=acuity)


def score_data_quality() -> Column:
    """High means poor quality."""
    missing = number(feature("missing_ratio"), 0)
    stale = flag_number(F.col("stale"))
    thin = flag_number(F.col("insufficient_observations"))
    score = capped(missing * 0.5 + stale * 0.3 + thin * 0.2)
    label = F.when(score >= 0.4, "data_quality_issue").otherwise("quality_ok")
    return _score(score, label, 0.9, missing=missing, stale=stale, insufficient=thin)


def score_risk(model: RiskModel) -> Column:
    z = F.lit(model.intercept)
    for weight, value in zip(model.weights, model_inputs(RISK_INPUTS)):
        z = z + F.lit(weight) * value
    p = sigmoid(z)
    return _score(p, F.when(p >= 0.55, "elevated_risk").otherwise("low_risk"), F.greatest(p, 1.0 - p))


def score_isolation_forest(raw: Column) -> Column:
    """From the negated decision function of a forest (``forest.with_forest_raw``)."""
    p = sigmoid((raw - 0.05) * 4.0)
    return _score(
        p,
        F.when(p >= 0.65, "anomalous").otherwise("nominal"),
        F.least(F.lit(0.99), F.abs(p - 0.5) * 1.8 + 0.4),
        decision_function=raw,
    )


def forest_column(model_name: str) -> str:
    return f"raw_{model_name}"


Scorers = dict[str, Callable[[], Column]]


@functools.cache
def scorers(risk: RiskModel | None = None, forests: tuple[str, ...] = ()) -> Scorers:
    """The available scorers; a model without one counts as unreachable (its breaker is open)."""
    built: Scorers = {
        "threshold_detector": score_threshold,
        "capacity_forecaster": score_capacity,
        "imaging_prioritizer": score_imaging,
        "data_quality_scorer": score_data_quality,
    }
    if risk is not None:
        built["risk_predictor"] = lambda: score_risk(risk)
    for name in forests:
        built[name] = lambda name=name: score_isolation_forest(F.col(forest_column(name)))
    return built


def classify_outcome(latency_ms: Column, failed: Column, breaker_open: Column, limit_ms: Column | int) -> Column:
    """Outcome of one model call: a call beyond its limit was cut off before it could fail."""
    limit = F.lit(limit_ms) if isinstance(limit_ms, int) else limit_ms
    return (
        F.when(F.coalesce(breaker_open, F.lit(False)), "circuit_open")
        .when(latency_ms > limit, "timeout")
        .when(F.coalesce(failed, F.lit(False)), "error")
        .otherwise("success")
    )


def attach_call_log(vectors: DataFrame, call_log: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Add ``calls``: per event a map of model name to its (first) call.

    One aggregate per registered model, combined before the only shuffle of the log: copies of a call never
    meet in a list.
    """
    call = F.struct("called_at", "latency_ms", "failed", "breaker_open")
    first = call_log.groupBy("event_id").agg(
        *[F.min(F.when(F.col("model_name") == m.name, call)).alias(f"_{m.name}") for m in registry.models]
    )
    entries = []
    for m in registry.models:
        c = F.col(f"_{m.name}")
        entries += [F.lit(m.name), F.when(c.isNotNull(), F.struct(c["latency_ms"], c["failed"], c["breaker_open"]))]
    calls = first.select("event_id", F.create_map(*entries).cast(CALL_TYPE).alias("calls"))
    return vectors.join(calls, "event_id", "left")


def _prediction(model: Model, status: Column, score: Column | None, latency: Column, **tags: Column) -> Column:
    """Prediction row; hash, score, label and confidence only when the model answered."""
    answered = status.isin("success", "fallback", "shadow")
    field = lambda name, kind: (
        F.lit(None).cast(kind) if score is None else F.when(answered, score[name])
    ).alias(name)
    # A model that could not be called has no latency of its own.
    return F.struct(
        F.lit(model.name).alias("model_name"),
        F.lit(model.version).alias("model_version"),
        F.when(answered, model_hash(F.lit(model.name), F.lit(model.version))).alias("model_hash"),
        field("score", "double"),
        field("label", "string"),
        field("confidence", "double"),
        F.when(status == "circuit_open", F.lit(0.0)).otherwise(F.coalesce(latency, F.lit(0.0))).alias("latency_ms"),
        status.alias("status"),
        F.lit(model.shadow and "fallback_for" not in tags).alias("shadow"),
        field("explanation", "map<string,string>"),
        tags.get("fallback_for", F.lit(None).cast("string")).alias("fallback_for"),
        tags.get("primary_status", F.lit(None).cast("string")).alias("primary_status"),
    )


def _outcome_column(model: Model, limit_ms: int) -> str:
    return f"_outcome_{model.name}_{limit_ms}"


@built_once
def _outcome_columns(registry: Registry) -> tuple[dict[str, Column], dict[str, Column]]:
    """The logged call and the (status, latency) of every call that a routed model or its fallback makes.

    They are columns of their own, call first: each field of a prediction asks for them, and as expressions they would be
    worked out from the log again for every field.
    """
    kinds: dict[tuple[Model, int], list[str]] = {}
    for event_type, _ in registry.routing:
        for m in registry.routed(event_type):
            kinds.setdefault((m, m.timeout_ms), []).append(event_type)
            fallback = registry.find(m.fallback)
            if fallback is not None:
                kinds.setdefault((fallback, FALLBACK_TIMEOUT_MS), []).append(event_type)
    logged, outcomes = {}, {}
    for (m, limit_ms), types in kinds.items():
        name = _outcome_column(m, limit_ms)
        logged[f"_call{name}"] = F.when(F.col("event_type").isin(*types), F.try_element_at("calls", F.lit(m.name)))
        call = F.col(f"_call{name}")
        # A call beyond its limit was cut off there, so it took no longer.
        outcomes[name] = F.struct(
            classify_outcome(call["latency_ms"], call["failed"], call["breaker_open"], limit_ms).alias("status"),
            F.when(call["latency_ms"].isNotNull(), F.least(call["latency_ms"], F.lit(float(limit_ms)))).alias("latency"),
        )
    return logged, outcomes


def _outcome(model: Model, limit_ms: int, available: Scorers, logged: bool) -> tuple[Column, Column]:
    """(status, latency) of one call; without a log every reachable model answers at once."""
    if model.name not in available:
        return F.lit("circuit_open"), F.lit(0.0)
    if not logged:
        return F.lit("success"), F.lit(0.0)
    outcome = F.col(_outcome_column(model, limit_ms))
    return outcome["status"], outcome["latency"]


def resolve_fallback(model: Model, registry: Registry, available: Scorers, logged: bool) -> Column:
    """The model's prediction, or its fallback's in its place when the call did not succeed.

    ``logged``: the outcomes of the calls are columns (``_outcome_columns``).
    """
    outcome, latency = _outcome(model, model.timeout_ms, available, logged)
    score = available[model.name]() if model.name in available else None
    answer = F.lit("shadow" if model.shadow else "fallback" if model.name == "threshold_detector" else "success")
    own = _prediction(model, F.when(outcome == "success", answer).otherwise(outcome), score, latency)
    fallback = registry.find(model.fallback)
    if fallback is None:
        return own
    fb_outcome, fb_latency = _outcome(fallback, FALLBACK_TIMEOUT_MS, available, logged)
    fb_answer = F.lit("fallback" if fallback.name == "threshold_detector" else "success")
    other = _prediction(
        fallback,
        F.when(fb_outcome == "success", fb_answer).otherwise(fb_outcome),
        available[fallback.name]() if fallback.name in available else None,
        fb_latency,
        fallback_for=F.lit(model.name),
        primary_status=outcome,
    )
    return F.when(outcome == "success", own).otherwise(other)


def predict(
    vectors: DataFrame,
    available: Scorers,
    registry: Registry = REGISTRY,
) -> DataFrame:
    """Add ``predictions`` (one struct per routed model, in routing order) and ``inference_status``.

    With a ``calls`` column (see ``attach_call_log``) the logged outcomes decide about fallbacks.
    """
    columns, logged = vectors.columns, "calls" in vectors.columns
    if logged:
        calls, outcomes = _outcome_columns(registry)
        vectors = vectors.withColumns(calls).withColumns(outcomes)
    routed = _predictions(tuple(available.items()), registry, logged)
    return vectors.select(*columns, routed.alias("predictions")).withColumn("inference_status", inference_status())


@built_once
def _predictions(available: tuple[tuple[str, Callable[[], Column]], ...], registry: Registry, logged: bool) -> Column:
    by_type = F.expr(f"cast(array() as array<{PREDICTION_TYPE}>)")
    for event_type, _ in registry.routing:
        entries = [
            resolve_fallback(m, registry, dict(available), logged).cast(PREDICTION_TYPE)
            for m in registry.routed(event_type)
        ]
        if entries:
            by_type = F.when(F.col("event_type") == event_type, F.array(*entries)).otherwise(by_type)
    return by_type


@built_once
def inference_status() -> Column:
    """A failed primary that a fallback replaced leaves no row, so it does not count as partial."""
    cut_short = F.exists("predictions", lambda p: p["status"].isin("timeout", "error"))
    return F.when(cut_short, "PARTIAL_SUCCESS").otherwise("INFERENCE")


def prediction_rows(scored: DataFrame) -> DataFrame:
    """Predictions as table rows with deterministic ids.

    Spark adds a filter on arrays that a generator reads; below it the whole expression of the predictions would run twice.
    """
    whole = settled(scored.select("event_id", "arrival_time", "predictions"))
    rows = whole.select("event_id", "arrival_time", F.posexplode("predictions").alias("position", "p"))
    return rows.select(
        stable_id("prediction", F.col("event_id"), F.col("position").cast("string")).alias("id"),
        "event_id",
        "position",
        "p.*",
        F.col("arrival_time").alias("created_at"),
    )


def collect_predictions(rows: DataFrame) -> DataFrame:
    """Prediction rows back to one ordered array per event.

    Rows are first cut to one per event and position, so an array is bounded by the routing list
    whatever number of copies the table holds.
    """
    from tributary.operators.dedup import keep_first

    names = ["model_name", "model_version", "model_hash", "score", "label", "confidence", "latency_ms", "status"]
    names += ["shadow", "explanation", "fallback_for", "primary_status"]
    unique = keep_first(rows, ["event_id", "position"], [F.col("created_at"), F.col("id")])
    ordered = F.array_sort(
        F.collect_list(F.struct("position", F.struct(*names).alias("p"))),
        lambda a, b: a["position"] - b["position"],
    )
    return unique.groupBy("event_id").agg(F.transform(ordered, lambda x: x["p"]).alias("predictions"))
