"""Alerts, lifecycle, reports and metrics against step-by-step computations."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tributary.operators import alerts as A
from tributary.operators import metrics as M
from tributary.operators import reports as R
from tributary.settings import Settings

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
DECISION = """id string, event_id string, patient_id string, resource_id string, source_id string, severity string,
action string, decision_score double, triggered_rules array<string>, explanation struct<ai:string>, trace_id string,
created_at timestamp, arrival_time timestamp"""


def at(seconds):
    return START + timedelta(seconds=seconds)


def decision(i, seconds, action="REVIEW_RECOMMENDED", severity="HIGH", patient="p", rules=("low_spo2",), score=0.5):
    when = at(seconds)
    return (f"d{i}", f"e{i}", patient, "res", "src", severity, action, score, list(rules), ("x",), f"t{i}", when, when)


def test_alert_dedup_buckets(spark):
    rows = [
        decision(0, 0),
        decision(1, 299),
        decision(2, 300),
        decision(3, 10, "MONITOR", "LOW"),
        decision(4, 10, "MONITOR", "MEDIUM"),
        decision(5, 20, patient=None),
        decision(6, 20, patient=""),
    ]
    got = {r["event_id"]: r for r in A.open_alerts(spark.createDataFrame(rows, DECISION)).collect()}
    assert sorted(got) == ["e0", "e2", "e4", "e5"]
    assert got["e5"]["dedup_key"].startswith("res:REVIEW_RECOMMENDED:")
    assert len({r["id"] for r in got.values()}) == 4


def test_alert_message(spark):
    rows = [decision(0, 0, score=0.125), decision(1, 900, patient=None, rules=())]
    got = {r["event_id"]: r["message"] for r in A.open_alerts(spark.createDataFrame(rows, DECISION)).collect()}
    tail = "Synthetic data; not a clinical diagnosis."
    assert got["e0"] == f"REVIEW_RECOMMENDED (HIGH) for p — score=0.12, rules=[low_spo2]. {tail}"
    assert got["e1"] == f"REVIEW_RECOMMENDED (HIGH) for resource — score=0.50, rules=[model scores]. {tail}"


def test_lifecycle_equals_replaying_the_commands(spark):
    rng = random.Random(2)
    alerts = spark.createDataFrame([decision(i, i * 1000) for i in range(40)], DECISION)
    alerts = A.open_alerts(alerts)
    ids = sorted(r["id"] for r in alerts.collect())
    commands, expected, acks = [], {}, 0
    for a in ids:
        state = {"status": "OPEN", "ack": None, "by": None, "res": None}
        times = sorted(rng.sample(range(100), rng.randrange(0, 6)))
        for t in times:
            kind, actor = rng.choice(["ack", "resolve"]), rng.choice(["ana", "ben"])
            commands.append((a, kind, actor, at(t), f"{a}-{t}"))
            if kind == "resolve":
                state["status"], state["res"] = "RESOLVED", at(t)
            elif state["status"] in ("OPEN", "CREATED"):
                state.update(status="ACKNOWLEDGED", ack=at(t), by=actor)
                acks += 1
        expected[a] = state
    rng.shuffle(commands)
    table = spark.createDataFrame(
        commands, "alert_id string, command string, actor string, at timestamp, command_id string"
    )
    naive = lambda t: t.replace(tzinfo=None) if t else None
    for r in A.alert_lifecycle(alerts, table).collect():
        e = expected[r["id"]]
        assert (r["status"], naive(r["acknowledged_at"]), r["acknowledged_by"], naive(r["resolved_at"])) == (
            e["status"],
            naive(e["ack"]),
            e["by"],
            naive(e["res"]),
        )
    events = spark.createDataFrame([("e", "t", at(0))], "event_id string, trace_id string, arrival_time timestamp")
    counted = {r["action"]: r["count"] for r in A.audit_trail(events, alerts, table).groupBy("action").count().collect()}
    assert counted == {
        "EVENT_VALIDATED": 1,
        "ALERT_CREATED": 40,
        "ALERT_ACKNOWLEDGED": acks,
        "ALERT_RESOLVED": sum(c[1] == "resolve" for c in commands),
    }


@pytest.mark.parametrize("upper", [False, True])
def test_quantile_by_position(spark, upper):
    rng = random.Random(4)
    rows = [("hot", rng.choice([5.0, 5.0001, rng.uniform(0, 200)])) for _ in range(3000)]
    rows += [("ten", float(i)) for i in range(10)] + [("one", 7.5)] + [("low", -1.5), ("low", -0.2)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["v"] for r in R.quantile_by_position(df, ["k"], "v", 0.95, upper=upper).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        place = 0.95 * (len(values) - 1)
        assert got[key] == values[-int(-place // 1) if upper else int(place)]


def test_model_stats(spark):
    rows = [("m", "1", "success" if i % 3 else "timeout", None if i == 0 else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "model_name string, model_version string, status string, latency_ms double")
    got = R.model_stats(df).first()
    assert (got["count"], got["success_rate"], got["p95_ms"]) == (10, 0.6, 8.0)


def test_breaker_states(spark):
    def run(outcomes, now):
        rows = [("anomaly_detector", ok, at(t), f"e{t}") for t, ok in enumerate(outcomes)]
        df = spark.createDataFrame(rows, "model_name string, ok boolean, at timestamp, event_id string")
        settings = Settings(breaker_threshold=3)
        got = R.breaker_state(df, F.lit(at(now)).cast("timestamp"), settings).first()
        return got["state"], got["failures"]

    assert run([False] * 3, 5) == ("OPEN", 3)
    assert run([False] * 3, 17) == ("HALF_OPEN", 3)
    assert run([False, False, True, False], 5) == ("CLOSED", 1)
    assert run([True, False, False, False, False], 6) == ("OPEN", 4)
    assert run([False, False, False, True], 6) == ("CLOSED", 0)


def test_timeline_limits_every_patient(spark):
    events = spark.createDataFrame(
        [(f"e{i:03}", "p1" if i % 3 else "p2", at(i), "lab_result") for i in range(60)],
        "event_id string, patient_id string, event_time timestamp, event_type string",
    )
    alerts = A.open_alerts(spark.createDataFrame([decision(0, 0, patient="p1")], DECISION))
    made = spark.createDataFrame([decision(0, 0, patient="p1")], DECISION)
    patients = spark.createDataFrame([("p1", "Name", "w")], "external_ref string, display_name string, ward_id string")
    rows = R.patient_timeline(events, alerts, made, patients, severity="LOW", limit=5).collect()
    assert {(r["patient_id"], r["kind"]) for r in rows} == {("p1", "event"), ("p2", "event"), ("p1", "decision")}
    assert sorted(r["ref"] for r in rows if r["patient_id"] == "p2") == ["e045", "e048", "e051", "e054", "e057"]
    assert {r["patient_id"]: r["display_name"] for r in rows} == {"p1": "Name", "p2": "p2"}
    plan = R.patient_timeline(events, alerts, made, patients)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan


def test_overview_of_nothing(spark):
    events = spark.createDataFrame([], "patient_id string, arrival_time timestamp")
    alerts = spark.createDataFrame([], "status string, severity string")
    predictions = spark.createDataFrame([], "status string")
    row = R.overview(events, alerts, predictions, F.lit(at(0)).cast("timestamp")).first()
    assert (row["events_per_min"], row["active_patients"], row["open_alerts"]) == (0, 0, 0)
    assert (row["model_success_rate"], row["alerts_by_severity"]) == (1.0, {})


def test_quota(spark):
    rng = random.Random(9)
    rows = [("u" if i % 3 else "v", i, at(rng.randrange(0, 180))) for i in range(900)]
    df = spark.createDataFrame(rows, "user string, i int, ts timestamp")
    got = {r["i"]: r for r in M.quota_flag(df, "user", "ts", "i").collect()}
    seen = {}
    for user, i, when in sorted(rows, key=lambda r: (r[2], r[1])):
        cell = (user, int(when.timestamp()) // 60)
        seen[cell] = seen.get(cell, 0) + 1
        assert got[i]["request_number"] == seen[cell]
        assert got[i]["remaining"] == max(0, 120 - seen[cell])
        assert got[i]["refused"] == (seen[cell] > 120)


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([(x, at(0)) for x in (0.01, 0.05, 0.07, 0.3, 9.0)], "s double, ts timestamp")
    bounds = (0.05, 0.1, 0.5)
    got = {r["le"]: r["count"] for r in M.latency_histogram(df, [], F.col("s"), bounds).collect()}
    assert got == {"0.05": 2, "0.1": 3, "0.5": 4, "+Inf": 5}
    q = lambda p: M.histogram_quantile(df, [], "ts", F.col("s"), bounds, p, "5 minutes").first()["quantile"]
    assert q(0.2) == pytest.approx(0.025)
    assert q(0.5) == pytest.approx(0.05 + 0.05 * 0.5)
    assert q(0.95) == 0.5


def test_counter_rate(spark):
    df = spark.createDataFrame([("a", at(t)) for t in (0, 14, 15, 70)], "k string, ts timestamp")
    got = {(r["window_start"] - at(0).replace(tzinfo=None)).total_seconds(): r["rate"] for r in M.counter_rate(df, ["k"], "ts").collect()}
    assert got[0.0] == pytest.approx(3 / 60) and got[15.0] == pytest.approx(2 / 60) and got[-45.0] == pytest.approx(2 / 60)
