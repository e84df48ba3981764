"""Models, outcomes, fallbacks, rules and decisions on literal rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.functions.columns import round_even
from tributary.operators import decisions as D
from tributary.operators import scoring as S
from tributary.operators.forest import CONTAMINATION, fit_forest, forest_offsets, with_forest_raw
from tributary.operators.registry import Model, Registry, model_hash, route_models
from tributary.operators.risk import train_risk_model

FEATURES = (
    "heart_rate double, spo2 double, respiratory_rate double, temperature_c double, systolic_bp double, "
    "heart_rate_mean_5m double, spo2_delta_5m double, hr_variance_5m double, spo2_min_5m double, "
    "missing_ratio double, occupancy_ratio double, occupied_count bigint, waiting_minutes bigint, acuity_code int, "
    "modality_code int"
)
NAMES = [part.split()[0] for part in FEATURES.split(", ")]
ROW = (
    f"event_id string, event_type string, patient_id string, resource_id string, source_id string, trace_id string, "
    f"arrival_time timestamp, features struct<{', '.join(p.replace(' ', ':', 1) for p in FEATURES.split(', '))}>, "
    "stale boolean, insufficient_observations boolean"
)


def vectors(spark, rows):
    """rows: (event_id, event_type, features dict[, stale, insufficient])"""
    data = []
    for event_id, kind, features, *flags in rows:
        stale, thin = (flags + [False, False])[:2]
        values = tuple(features.get(n, 0.0 if n == "missing_ratio" else None) for n in NAMES)
        data.append((event_id, kind, "pat_1", None, "src_1", "trace_1", values, stale, thin))
    flat = ROW.replace("arrival_time timestamp, ", "")
    return spark.createDataFrame(data, flat).withColumn("arrival_time", F.lit("2024-03-01 12:00:00").cast("timestamp"))


def one(df, column):
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "features,score,label,confidence",
    [
        ({"heart_rate": 121.0, "spo2": 91.0, "respiratory_rate": 27.0}, 1.0, "anomalous", 0.7),
        ({"heart_rate": 120.0, "spo2": 92.0, "respiratory_rate": 26.0}, 0.05, "nominal", 0.55),
        ({"heart_rate": 44.0}, 1 / 3 + 0.35, "anomalous", 0.7),
        ({}, 0.05, "nominal", 0.55),
    ],
)
def test_threshold(spark, features, score, label, confidence):
    got = one(vectors(spark, [("e", "patient_vital", features)]), S.score_threshold().alias("s"))
    assert (got["score"], got["label"], got["confidence"]) == (pytest.approx(score), label, confidence)


def test_weighted_scores(spark):
    df = vectors(
        spark,
        [
            ("bed", "bed_status", {"occupancy_ratio": 0.8, "occupied_count": 4}),
            ("none", "bed_status", {}),
            ("img", "imaging_request", {"waiting_minutes": 90, "acuity_code": 3, "modality_code": 3}),
            ("dq", "patient_vital", {"missing_ratio": 2 / 3}, True, True),
        ],
    )
    capacity = {r[0]: r[1] for r in df.select("event_id", S.score_capacity().alias("s")).collect()}
    assert capacity["bed"]["score"] == pytest.approx(0.85) and capacity["none"]["score"] == pytest.approx(0.525)
    img = {r[0]: r[1] for r in df.select("event_id", S.score_imaging().alias("s")).collect()}["img"]
    assert (img["score"], img["label"]) == (pytest.approx(0.25 + 0.35 + 0.09), "prioritize")
    dq = {r[0]: r[1] for r in df.select("event_id", S.score_data_quality().alias("s")).collect()}["dq"]
    assert (dq["score"], dq["label"]) == (pytest.approx(1 / 3 + 0.5), "data_quality_issue")


def test_routing(spark):
    df = vectors(spark, [(k, k, {}) for k in ("patient_vital", "bed_status", "appointment_event", "other")])
    routed = {r[0]: [m["model_name"] for m in r[1]] for r in df.select("event_id", route_models(F.col("event_type"))).collect()}
    assert {"anomaly_detector", "risk_predictor"} <= set(routed["patient_vital"])
    assert "capacity_forecaster" in routed["bed_status"]
    assert routed["appointment_event"] == [] and routed["other"] == []
    off = Registry(models=(Model("capacity_forecaster", "1.0", enabled=False), Model("data_quality_scorer", "1.0")))
    kept = df.filter("event_type = 'bed_status'").select(route_models(F.col("event_type"), off)).first()[0]
    assert [m["model_name"] for m in kept] == ["data_quality_scorer"]


def test_model_hash(spark):
    got = spark.range(1).select(model_hash(F.lit("anomaly_detector"), F.lit("2.1"))).first()[0]
    assert got == hashlib.sha256(b"anomaly_detector:2.1").hexdigest()[:16]


def test_outcomes_and_fallback(spark):
    df = vectors(spark, [(f"e{i}", "patient_vital", {"heart_rate": 130.0}) for i in range(5)])
    log = [
        ("e0", "anomaly_detector", 10.0, False, False),
        ("e1", "anomaly_detector", 151.0, True, False),
        ("e2", "anomaly_detector", 10.0, True, False),
        ("e3", "anomaly_detector", 10.0, False, True),
        ("e4", "risk_predictor", 201.0, False, False),
        ("e4", "risk_predictor", 201.0, False, False),
        ("e1", "threshold_detector", 51.0, False, False),
    ]
    calls = spark.createDataFrame(
        log, "event_id string, model_name string, latency_ms double, failed boolean, breaker_open boolean"
    ).withColumn("called_at", F.current_timestamp())
    risk = S.RiskModel(0.0, (0.0,) * 6)
    available = S.scorers(risk, ("anomaly_detector",))
    called = S.attach_call_log(df, calls).withColumn("raw_anomaly_detector", F.lit(0.05))
    got = {r["event_id"]: r for r in S.predict(called, available).collect()}
    first = {e: got[e]["predictions"][0] for e in got}
    assert (first["e0"]["model_name"], first["e0"]["status"], first["e0"]["score"]) == ("anomaly_detector", "success", 0.5)
    assert [first[e]["primary_status"] for e in ("e1", "e2", "e3")] == ["timeout", "error", "circuit_open"]
    assert {first[e]["fallback_for"] for e in ("e1", "e2", "e3")} == {"anomaly_detector"}
    assert first["e1"]["status"] == "timeout" and first["e1"]["score"] is None
    assert first["e2"]["status"] == "fallback" and first["e2"]["model_name"] == "threshold_detector"
    assert [got[e]["inference_status"] for e in sorted(got)] == [
        "INFERENCE",
        "PARTIAL_SUCCESS",
        "INFERENCE",
        "INFERENCE",
        "PARTIAL_SUCCESS",
    ]
    # The shadow model has no scorer here: unreachable, still marked as shadow.
    shadow = got["e0"]["predictions"][3]
    assert (shadow["status"], shadow["shadow"], shadow["score"]) == ("circuit_open", True, None)
    rows = S.prediction_rows(S.predict(called, available))
    back = S.collect_predictions(rows.unionByName(rows)).filter("event_id = 'e0'").first()
    assert [p["model_name"] for p in back["predictions"]] == [p["model_name"] for p in got["e0"]["predictions"]]


def prediction(name, score, confidence, status="success", shadow=False):
    return (name, "1", None, score, None, confidence, 0.0, status, shadow, None, None, None)


def decided(spark, kind, features, predictions):
    df = vectors(spark, [("e", kind, features)])
    listed = spark.createDataFrame([("e", predictions)], f"event_id string, predictions array<{S.PREDICTION_TYPE}>")
    return D.decide(df.join(listed, "event_id")).first()


def test_decision_weighs_scores_and_rules(spark):
    got = decided(
        spark,
        "patient_vital",
        {"heart_rate": 144.0, "spo2": 89.5, "respiratory_rate": 30.0, "spo2_min_5m": 89.5},
        [prediction("anomaly_detector", 0.72, 0.88), prediction("risk_predictor", 0.66, 0.64)],
    )
    assert (got["severity"], got["action"]) == ("HIGH", "REVIEW_RECOMMENDED")
    assert got["triggered_rules"] == ["low_spo2", "tachycardia", "high_respiratory_rate"]
    assert (got["decision_score"], got["confidence"]) == (0.747, 0.76)  # 0.45, 0.3 and 0.25 (rule of 0.9); the mean
    assert got["explanation"]["rule_reasons"][0] == "SpO2 89.5 below 92"
    assert got["explanation"]["partial"] is False


OK = [prediction("risk_predictor", 0.1, 0.9)]
RULE_CASES = [
    ({"spo2": 92.0}, [], None),
    ({"spo2": 91.9}, ["low_spo2"], "HIGH"),
    ({"spo2": 95.0, "spo2_min_5m": 87.9}, ["low_spo2"], "CRITICAL"),
    ({"heart_rate": 119.9}, [], None),
    ({"heart_rate": 120.0}, ["tachycardia"], "MEDIUM"),
    ({"heart_rate": 140.0}, ["tachycardia"], "HIGH"),
    ({"respiratory_rate": 26.0}, ["high_respiratory_rate"], "HIGH"),
    ({"occupancy_ratio": 0.8}, ["resource_congestion"], "MEDIUM"),
    ({"occupancy_ratio": 0.9}, ["resource_congestion"], "HIGH"),
    ({"waiting_minutes": 89}, [], None),
    ({"waiting_minutes": 90}, ["imaging_backlog"], "HIGH"),
    ({"missing_ratio": 2 / 3}, ["data_quality_issue"], "LOW"),
    ({"missing_ratio": 0.65}, [], None),
]


@pytest.mark.parametrize("features,names,severity", RULE_CASES)
def test_rule_limits(spark, features, names, severity):
    got = decided(spark, "device_reading", features, OK)
    assert got["triggered_rules"] == names
    assert got["severity"] == (severity or "LOW")


@pytest.mark.parametrize(
    "kind,features,predictions,action",
    [
        ("patient_vital", {"occupancy_ratio": 0.95, "missing_ratio": 1.0}, OK, "RESOURCE_CONGESTION"),
        ("patient_vital", {"missing_ratio": 1.0}, OK, "DATA_QUALITY_ISSUE"),
        ("appointment_event", {}, [], "MODEL_CONFIDENCE_LOW"),
        ("imaging_request", {"waiting_minutes": 100}, [], "REVIEW_RECOMMENDED"),
        ("patient_vital", {"heart_rate": 125.0}, OK, "ANOMALY_DETECTED"),
        ("patient_vital", {"spo2": 80.0}, OK, "REVIEW_RECOMMENDED"),
        ("lab_result", {}, OK, "MONITOR"),
        ("lab_result", {}, [prediction("risk_predictor", 0.9, 0.4)], "MODEL_CONFIDENCE_LOW"),
        ("lab_result", {}, [prediction("data_quality_scorer", 0.4, 0.9, "shadow", True)] + OK, "DATA_QUALITY_ISSUE"),
    ],
)
def test_action_precedence(spark, kind, features, predictions, action):
    assert decided(spark, kind, features, predictions)["action"] == action


def test_score_parts_and_escalation(spark):
    bed = decided(spark, "bed_status", {}, [prediction("capacity_forecaster", 1.0, 0.8)])
    assert (bed["decision_score"], bed["severity"]) == (0.7, "MEDIUM")
    high = decided(
        spark, "bed_status", {"occupancy_ratio": 0.8}, [prediction("capacity_forecaster", 1.0, 0.8)]
    )
    assert (high["decision_score"], high["severity"]) == (0.865, "HIGH")
    # An anomaly score of 0 gives way to the threshold detector; shadow predictions do not count.
    fallback = decided(
        spark,
        "patient_vital",
        {},
        [
            prediction("anomaly_detector", 0.0, None),
            prediction("threshold_detector", 1.0, 0.7, "fallback"),
            prediction("risk_predictor", 1.0, 0.9, "shadow", True),
        ],
    )
    assert fallback["explanation"]["components"]["anomaly"] == 1.0
    assert fallback["explanation"]["components"]["risk"] == 0.0
    assert fallback["explanation"]["shadow_models"] == ["risk_predictor"]
    assert fallback["confidence"] == 0.7


def test_round_even_is_python_round(spark):
    rng = np.random.default_rng(1)
    values = [0.12345, 0.265, 0.125, 0.00735, 2.675, 1.0, 0.0, 0.5]
    values += [float(x) for x in rng.random(3000)] + [k * 0.00735 for k in range(200)] + [k / 8 for k in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 4):
        got = [r[0] for r in df.select(round_even(F.col("x"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def training_vitals(spark, n=1500):
    rng = np.random.default_rng(3)
    rows = [
        (
            f"e{i:05}",
            "patient_vital",
            {
                "heart_rate": float(rng.normal(95, 15)),
                "spo2": float(rng.normal(96, 2)),
                "respiratory_rate": float(rng.normal(18, 4)),
                "heart_rate_mean_5m": float(rng.normal(95, 6)),
                "spo2_delta_5m": float(rng.normal(0, 0.4)),
                "hr_variance_5m": float(rng.uniform(1, 10)),
            },
        )
        for i in range(n)
    ]
    rows.append(("far", "patient_vital", {"heart_rate": 250.0, "spo2": 50.0, "respiratory_rate": 70.0, "hr_variance_5m": 900.0}))
    return vectors(spark, rows)


def test_isolation_forest_properties(spark):
    df = training_vitals(spark).cache()
    forest = fit_forest(df)
    assert len(forest.roots) == 60 and forest.sample == 256
    offsets = forest_offsets(df, forest, CONTAMINATION)
    assert offsets["anomaly_detector"] < offsets["anomaly_detector_shadow"]
    raw = with_forest_raw(df, forest, offsets)
    got = raw.select(
        "event_id",
        S.score_isolation_forest(F.col("raw_anomaly_detector")).alias("a"),
        S.score_isolation_forest(F.col("raw_anomaly_detector_shadow")).alias("b"),
        "raw_anomaly_detector",
    ).collect()
    scores = {r["event_id"]: r["a"]["score"] for r in got}
    assert max(scores, key=scores.get) == "far"
    assert all(r["b"]["score"] > r["a"]["score"] for r in got)
    # The offset is the exact linear percentile of the training scores.
    above = sum(r["raw_anomaly_detector"] > 0 for r in got)
    assert abs(above - 0.03 * (len(got) - 1)) <= 1
    values = np.array([offsets["anomaly_detector"] - r["raw_anomaly_detector"] for r in got])
    assert offsets["anomaly_detector"] == pytest.approx(np.percentile(values, 3.0), abs=1e-9)


def test_risk_model_separates(spark):
    df = training_vitals(spark)
    model = train_risk_model(df)
    got = df.select("event_id", S.score_risk(model).alias("s")).collect()
    assert dict((r[0], r[1]) for r in got)["far"]["label"] == "elevated_risk"
    assert model.weights[0] > 0 > model.weights[1]


def test_predictions_are_worked_out_once_per_event(spark):
    """No filter below the generator holds the expression once more, and no field of a prediction looks its call up again."""
    calls = "map<string,struct<latency_ms:double,failed:boolean,breaker_open:boolean>>"
    called = vectors(spark, [("e", "patient_vital", {})]).withColumn("calls", F.lit(None).cast(calls))
    rows = S.prediction_rows(S.predict(called, S.scorers()))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert not [line for line in filters if "anomaly_detector" in line]
    routed = sum(len(names) for names in dict(Registry().routing).values())
    assert plan.count("try_element_at(") + plan.count("element_at(calls") <= 2 * routed
