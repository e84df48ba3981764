"""Failure codes per mutation of one good message."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tributary.operators.dedup import dedup_events, duplicate_report, replay_quarantine, upsert_dimension
from tributary.operators.validate import check_events, parse_time, quarantine_rows, split_valid_quarantine, valid_events
from tributary.schema import PAYLOADS

NOW = "2024-03-01 12:00:00"
GOOD = {
    "event_id": "evt_58",
    "source_id": "bedside_4",
    "event_type": "patient_vital",
    "patient_id": "pat_31",
    "device_id": "bedside_4",
    "resource_id": None,
    "timestamp": "2024-03-01T11:59:30+00:00",
    "schema_version": 1,
    "payload": {"heart_rate": 74, "spo2": 97, "temperature_c": 36.8},
    "trace_id": "trace_58_0001",
}
SAMPLES = {
    "device_reading": {"metric": "flow", "value": 1.5},
    "bed_status": {"ward_id": "w", "bed_id": "b", "status": "occupied", "occupancy_ratio": 0.5},
    "imaging_request": {"modality": "CT", "body_part": "knee", "waiting_minutes": 5},
    "lab_result": {"test_code": "t", "value": 2, "unit": "mg"},
    "resource_update": {"resource_type": "room", "resource_id": "r", "available": 1, "capacity": 2},
    "appointment_event": {"appointment_id": "a", "status": "arrived", "department": "d"},
}


def change(**parts):
    return json.dumps({**GOOD, **parts})


def payload(event_type, **parts):
    body = {**(GOOD["payload"] if event_type == "patient_vital" else SAMPLES[event_type]), **parts}
    return change(event_type=event_type, payload=body)


def without(event_type, field):
    body = {k: v for k, v in SAMPLES[event_type].items() if k != field}
    return change(event_type=event_type, payload=body)


OK, BAD, SKEW, PERMANENT = None, "INVALID_SCHEMA", "CLOCK_SKEW", "PERMANENT_FAILURE"
CASES = [
    (change(), OK),
    (change(unknown_envelope_key=1), OK),
    (change(patient_id=None), BAD),
    (change(patient_id=""), BAD),
    (change(patient_id=7), BAD),
    (change(event_id="ab"), BAD),
    (change(event_id="x" * 65), BAD),
    (change(event_id="    "), BAD),
    (change(event_id=12345), BAD),
    (change(source_id=""), BAD),
    (change(trace_id="short"), BAD),
    (change(event_type="unknown"), BAD),
    (change(schema_version=9), BAD),
    (change(schema_version="2"), OK),
    (change(schema_version=1.0), OK),
    (change(schema_version=1.5), BAD),
    (change(payload=5), BAD),
    (change(payload=None), BAD),
    ("not json", BAD),
    ("[1, 2]", BAD),
    ("", BAD),
    (change(timestamp="2024-03-01T15:00:00+00:00"), SKEW),
    (change(timestamp="2024-03-01T12:05:00Z"), OK),
    (change(timestamp="2024-03-01T12:05:00.000001Z"), SKEW),
    (change(timestamp="2024-02-29T12:00:00Z"), OK),
    (change(timestamp="2024-02-29T11:59:59Z"), BAD),
    (change(timestamp="yesterday"), BAD),
    (change(timestamp="2024-03-01T11:59:30"), BAD),
    (change(timestamp="2024-03-01"), BAD),
    (change(timestamp="2024-13-01T11:59:30Z"), BAD),
    (change(timestamp="2024-03-01 11:59:30Z"), OK),
    (change(timestamp="2024-03-01T11:59Z"), OK),
    (change(timestamp="2024-03-01T13:59:30+0200"), OK),
    (change(timestamp="20240301T115930Z"), OK),
    (change(timestamp="2024-03-01T11:59:30,5Z"), OK),
    (payload("patient_vital", heart_rate=900), BAD),
    (payload("patient_vital", heart_rate=300), OK),
    (payload("patient_vital", heart_rate=None), OK),
    (payload("patient_vital", heart_rate="80"), OK),
    (payload("patient_vital", heart_rate="80d"), BAD),
    (payload("patient_vital", heart_rate="fast"), BAD),
    (payload("patient_vital", heart_rate=[80]), BAD),
    (payload("patient_vital", note="x"), BAD),
    (payload("patient_vital", temperature_c=29.9), BAD),
    (payload("device_reading"), OK),
    (payload("device_reading", quality="bad"), BAD),
    (payload("device_reading", quality=None), BAD),
    (payload("device_reading", metric=5), BAD),
    (change(event_type="device_reading", payload=SAMPLES["device_reading"], device_id=None), BAD),
    (payload("bed_status", status="free"), BAD),
    (payload("bed_status", occupancy_ratio=1.01), BAD),
    (payload("imaging_request", waiting_minutes=10.0), OK),
    (payload("imaging_request", waiting_minutes=10.5), BAD),
    (payload("imaging_request", waiting_minutes="7"), OK),
    (payload("imaging_request", waiting_minutes="7e0"), BAD),
    (payload("imaging_request", acuity_hint=None), OK),
    (payload("imaging_request", acuity_hint="urgent"), BAD),
    (payload("lab_result", abnormal_flag="yes"), OK),
    (payload("lab_result", abnormal_flag="maybe"), BAD),
    (payload("lab_result", abnormal_flag=1), OK),
    (payload("lab_result", abnormal_flag=2), BAD),
    (payload("resource_update", available=-1), BAD),
    (payload("appointment_event", wait_minutes=None), BAD),
    (change(patient_id="p" * 101), PERMANENT),
    (change(patient_id="p" * 100), OK),
    *[(without(t, f.name), BAD) for t in SAMPLES for f in PAYLOADS[t] if f.required],
]


def raw_rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string").withColumn(
        "arrival_time", F.lit(NOW).cast("timestamp")
    )


def test_failure_codes(spark):
    raw = raw_rows(spark, [value for value, _ in CASES])
    found = {r["value"]: r["failure"] for r in check_events(raw).collect()}
    wrong = [
        (value, code, found[value])
        for value, code in CASES
        if (found[value]["code"] if found[value] else None) != code
    ]
    assert not wrong


def test_valid_plus_quarantine_is_everything(spark):
    raw = raw_rows(spark, [value for value, _ in CASES])
    valid, held = split_valid_quarantine(raw)
    assert valid.count() + held.count() == len(CASES)
    assert {r["payload"] for r in held.select("payload").collect()} == {v for v, code in CASES if code}


def test_typed_values_and_defaults(spark):
    raw = raw_rows(
        spark,
        [
            payload("patient_vital", heart_rate="75.5"),
            payload("device_reading"),
            payload("lab_result", abnormal_flag="on"),
            change(event_id=" evt_x "),
        ],
    )
    rows = {r["i"]: r for r in valid_events(check_events(raw)).join(raw.select("i", "value"), "value").collect()}
    assert rows[0]["attributes"]["patient_vital"]["heart_rate"] == 75.5
    assert rows[1]["attributes"]["device_reading"]["quality"] == "good"
    assert rows[2]["attributes"]["lab_result"]["abnormal_flag"] is True
    assert rows[3]["event_id"] == "evt_x"
    assert rows[1]["attributes"]["patient_vital"] is None


def test_a_hundred_copies_keep_one(spark):
    raw = raw_rows(spark, [change()] * 100)
    valid = valid_events(check_events(raw))
    assert dedup_events(valid).count() == 1
    assert [tuple(r) for r in duplicate_report(valid).collect()] == [("evt_58", 99, 1)]


def test_dedup_cuts_copies_before_the_shuffle(spark):
    plan = dedup_events(valid_events(check_events(raw_rows(spark, [change()]))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in text.split("Exchange")[1] or "Partial" in text


def test_replay(spark):
    skewed = change(event_id="evt_skew", timestamp="2024-03-01T13:00:00Z")
    broken = change(event_id="evt_bad", schema_version=9)
    again = change(event_id="evt_seen", timestamp="2024-03-01T13:00:00Z")
    held = quarantine_rows(check_events(raw_rows(spark, [skewed, broken, again])))
    empty = held.limit(1).withColumns({"id": F.lit("none"), "payload": F.lit(None).cast("string")})
    held = held.unionByName(empty)
    accepted = spark.createDataFrame([("evt_seen",)], "event_id string")
    fresh, requeued, marked = replay_quarantine(
        held, held, accepted, F.lit("2024-03-01 13:00:00").cast("timestamp")
    )
    assert [r["event_id"] for r in fresh.collect()] == ["evt_skew"]
    assert [r["event_id"] for r in requeued.collect()] == ["evt_bad"]
    assert {r["id"] == "none": r["replayed"] for r in marked.collect()} == {False: True, True: False}


def test_upsert_keeps_existing(spark):
    old = spark.createDataFrame([("a", "old"), ("b", "old")], "k string, v string")
    new = spark.createDataFrame([("b", "new"), ("c", "new"), ("c", "new")], "k string, v string")
    assert sorted(map(tuple, upsert_dimension(old, new, "k").collect())) == [("a", "old"), ("b", "old"), ("c", "new")]


@pytest.mark.parametrize("column", ["error", "payload"])
def test_quarantine_keeps_long_texts(spark, column):
    long = change(event_type="x" * 5000)
    row = quarantine_rows(check_events(raw_rows(spark, [long]))).first()
    assert len(row["error"]) <= 2000
    assert row["payload"] == long


TIMES = [
    "2024-03-01T11:59:30+00:00", "2024-03-01T11:59:30.123456789Z", "2024-03-01T11+00:00", "2024-03-01T11:59:30+04",
    "2024-03-01_11:59:30+00:00", "2024-03-01-11:59:30-05:30", "2024-03-01T11:59:30+01:02:03", "2024-03-01T11:59:30-01:02:03.5",
    "20240301T115930Z", "20240301T1159+0200", "20240301T11:59Z", "2024-03-01T115930,25+02:00", "2024-03-01T11:59:30+20:00",
    "2024-W09-5T11:59:30Z", "2024W095T115930Z", "2024-W09T11Z", "2020-W53-7T00:00Z", "2021-W53-1T00:00Z", "2024-W00-1T00:00Z",
    "2024-W01-8T00:00Z", "2024-W01-0T00:00Z", "2024-13-01T11:59:30Z", "2024-02-30T11:59:30Z", "2024-03-01T24:01:00Z", "2024-03-01T11:60Z",
    "2024-03-01T11:59:60Z", "2024-03-01T11:5930Z", "2024-03-01T11:59.5Z", "2024-03-01T11,25+01.5", "2024-03-01T1Z", "2024-03-01T11:59:30", "2024-03-01",
    "20240301", "2024-W09", "2024-03-01T", "2024-13-01", "2024-03-01T11:59:30+0", "0000-01-01T00:00Z", "", "now", "2024-03-01T11:59:30+25:00",
]


def test_times_are_read_as_python_reads_them(spark):
    rows = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", F.unix_micros(parse_time(F.col("t"))).alias("us"))
    failures = {r["value"]: r["failure"] for r in check_events(raw_rows(spark, [change(timestamp=t) for t in TIMES])).collect()}
    wrong = []
    for t, us in map(tuple, rows.collect()):
        try:
            known = datetime.fromisoformat(t.replace("Z", "+00:00"))
            error = None if known.tzinfo else "timestamp must be timezone-aware"
        except ValueError:
            known, error = None, "timestamp is not ISO-8601"
        delta = None if known is None or error else known - datetime(1970, 1, 1, tzinfo=timezone.utc)
        expected = delta and (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
        failure = failures[change(timestamp=t)]
        said = failure["error"] if failure and ("not ISO" in failure["error"] or "aware" in failure["error"]) else None
        if us != expected or (said != error and t):
            wrong.append((t, us, expected, said, error))
    assert not wrong


def test_payload_values_are_converted_once(spark):
    """Bounds and required fields ask for a value several times; none of them converts it from the message again."""
    name, limit = "spark.sql.debug.maxToStringFields", "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        plan = check_events(raw_rows(spark, [change()]))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)
    gets = plan.count("payload[respiratory_rate]")
    assert 0 < gets <= 6, gets
    assert int(spark.conf.get(limit)) <= 8000  # above, methods are interpreted
