"""Rolling features against a brute-force window, with a hot patient and several slice widths."""

import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest

from tributary.operators.features import feature_vectors, latest_features
from tributary.operators.history import slice_width
from tributary.settings import Settings
from tributary.streaming.stages import new_vectors
from pyspark.sql import functions as F

VITAL = "struct<heart_rate:double,spo2:double,respiratory_rate:double,temperature_c:double,systolic_bp:double,diastolic_bp:double>"
BED = "struct<ward_id:string,bed_id:string,status:string,occupancy_ratio:double>"
SCHEMA = f"""event_id string, event_type string, patient_id string, event_time timestamp, arrival_time timestamp,
attributes struct<patient_vital:{VITAL},bed_status:{BED},
imaging_request:struct<modality:string,body_part:string,waiting_minutes:bigint,acuity_hint:string>,
lab_result:struct<test_code:string,value:double,unit:string,abnormal_flag:boolean>,
resource_update:struct<resource_type:string,resource_id:string,available:bigint,capacity:bigint>>"""
START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def vital(i, patient, ms, hr, spo2, rr):
    at = START + timedelta(milliseconds=ms)
    return (f"e{i:05}", "patient_vital", patient, at, at, ((hr, spo2, rr, 36.6, 120.0, 80.0), None, None, None, None))


def bed(i, patient, ms, status, ratio):
    at = START + timedelta(milliseconds=ms)
    return (f"e{i:05}", "bed_status", patient, at, at, (None, ("w", "b", status, ratio), None, None, None))


def sample():
    """A hot patient with a third of all rows, ties at one instant, gaps, and rows without a patient."""
    rng = random.Random(5)
    rows = []
    maybe = lambda x: None if rng.random() < 0.2 else x
    for i in range(600):
        patient = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "", None])
        ms = rng.choice([rng.randrange(0, 3_000_000), 10_000 * rng.randrange(0, 300)])
        rows.append(
            vital(i, patient, ms, maybe(rng.uniform(50, 180)), maybe(rng.uniform(80, 100)), maybe(rng.uniform(8, 30)))
        )
    for i in range(600, 700):
        status = rng.choice(["occupied", "available", "cleaning"])
        rows.append(bed(i, rng.choice(["ward", None]), rng.randrange(0, 3_000_000), status, maybe(rng.random())))
    return rows


def brute(rows, window_ms, as_of_arrival=False):
    came = lambda row: (row[4], row[0])
    ms = lambda row: round((row[3] - START).total_seconds() * 1000)
    out = {}
    for row in rows:
        near = [
            r
            for r in rows
            if r[1] == row[1] and r[2] == row[2] and row[2] and ms(row) - window_ms <= ms(r) <= ms(row)
            and (not as_of_arrival or came(r) <= came(row))
        ] or [row]
        near.sort(key=lambda r: (ms(r), r[0]))
        if row[1] == "patient_vital":
            cur = row[5][0]
            hrs, spo2s, rrs = ([r[5][0][c] for r in near if r[5][0][c] is not None] for c in range(3))
            out[row[0]] = {
                "heart_rate_mean_5m": statistics.fmean(hrs) if hrs else None,
                "heart_rate_min_5m": min(hrs, default=None),
                "heart_rate_max_5m": max(hrs, default=None),
                "hr_variance_5m": statistics.pvariance(hrs) if hrs else None,
                "hr_slope_5m": (hrs[-1] - hrs[0]) / (len(hrs) - 1) if len(hrs) > 1 else None,
                "spo2_mean_5m": statistics.fmean(spo2s) if spo2s else None,
                "spo2_min_5m": min(spo2s, default=None),
                "spo2_delta_5m": cur[1] - spo2s[0] if cur[1] is not None and spo2s else None,
                "rr_mean_5m": statistics.fmean(rrs) if rrs else None,
                "observation_count": len(near),
                "missing_ratio": sum(x is None for x in cur[:3]) / 3,
            }
        else:
            ratios = [r[5][1][3] for r in near if r[5][1][3] is not None]
            out[row[0]] = {
                "occupancy_ratio": row[5][1][3],
                "occupied_count": sum(r[5][1][2] == "occupied" for r in near),
                "available_count": sum(r[5][1][2] == "available" for r in near),
                "occupancy_mean": statistics.fmean(ratios) if ratios else None,
                "missing_ratio": 0.0 if row[5][1][3] is not None else 1.0,
            }
    return out


@pytest.mark.parametrize("window_ms,slice_ms", [(300_000, None), (300_000, 50_000), (300_000, 7_000), (1_000, None)])
def test_window_features_equal_brute_force(spark, window_ms, slice_ms):
    rows = sample()
    settings = Settings(window_ms=window_ms, slice_ms=slice_ms)
    assert_equal(feature_vectors(spark.createDataFrame(rows, SCHEMA), settings).collect(), brute(rows, window_ms))


def assert_equal(got, expected):
    assert len(got) == len(expected)
    for row in got:
        for name, value in expected[row["event_id"]].items():
            found = row["features"][name]
            assert (found is None) == (value is None), (row["event_id"], name, found, value)
            if value is not None:
                assert found == pytest.approx(value, abs=1e-7), (row["event_id"], name)


def out_of_order(seed, within_ms):
    """The sample with arrivals in any order within some time, and many equal ones."""
    rng = random.Random(seed)
    late = lambda: timedelta(milliseconds=rng.choice([0, 60_000, rng.randrange(0, within_ms)]))
    return [r[:4] + (r[3] + late(),) + r[5:] for r in sample()]


@pytest.mark.parametrize("window_ms,within_ms", [(300_000, 900_000), (3_000_000, 3_000_000), (1_000, 5_000), (20_000, 1)])
def test_history_as_of_arrival_equals_brute_force(spark, window_ms, within_ms):
    rows = out_of_order(window_ms, within_ms)
    settings = Settings(window_ms=window_ms, as_of_arrival=True)
    got = feature_vectors(spark.createDataFrame(rows[::-1], SCHEMA), settings).collect()
    assert_equal(got, brute(rows, window_ms, as_of_arrival=True))


def test_history_as_of_arrival_of_odd_rows(spark):
    """All events at one instant; arrivals that are null come first; no events give none."""
    settings = Settings(as_of_arrival=True)
    rows = [vital(i, "p", 0, 60.0 + i, 97.0, 15.0) for i in range(37)]
    rows[20] = rows[20][:4] + (None,) + rows[20][5:]
    got = {r.event_id: r.features["observation_count"] for r in feature_vectors(spark.createDataFrame(rows, SCHEMA), settings).collect()}
    assert got == {f"e{i:05}": 1 if i == 20 else i + 2 if i < 20 else i + 1 for i in range(37)}
    assert feature_vectors(spark.createDataFrame([], SCHEMA), settings).count() == 0


def test_stream_history_is_as_of_arrival(spark):
    """Lots in order of arrival but not of time: each lot against what came before equals all at once."""
    rows = sorted(out_of_order(3, 900_000), key=lambda r: (r[4], r[0]))
    settings = Settings(as_of_arrival=True)
    ms = lambda r: round((r[3] - START).total_seconds() * 1000) + round(START.timestamp() * 1000)
    got = []
    for start in range(0, len(rows), 250):
        lot = rows[start : start + 250]
        new, stored = (spark.createDataFrame(part, SCHEMA) for part in (lot, rows[:start]))
        got += new_vectors(new, stored, min(map(ms, lot)), max(map(ms, lot)), settings).collect()
    assert_equal(got, brute(rows, settings.window_ms, as_of_arrival=True))


def test_slices_divide_the_window():
    for window, wanted in [(300_000, None), (300_000, 7_000), (259_200_000, None), (1_000, 300)]:
        width = slice_width(window, wanted)
        assert window % width == 0
        assert width <= (wanted or max(300_000, window // 24))


def test_no_window_is_partitioned_by_patient_alone(spark):
    """The wide rows are shuffled by patient, type and slice."""
    plan = feature_vectors(spark.createDataFrame(sample()[:5], SCHEMA), Settings())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(history_key" in text
    assert all("_slice" in part.split(")")[0] for part in text.split("hashpartitioning(")[1:])


def test_other_types(spark):
    at = START
    rows = [
        ("i1", "imaging_request", "p", at, at, (None, None, ("CT", "knee", 90, None), None, None)),
        ("i2", "imaging_request", "p", at, at, (None, None, ("PET", "knee", 0, "high"), None, None)),
        ("l1", "lab_result", "p", at, at, (None, None, None, ("t", 2.5, "mg", True), None)),
        ("r1", "resource_update", None, at, at, (None, None, None, None, ("room", "r", 5, 20))),
        ("r2", "resource_update", None, at, at, (None, None, None, None, ("room", "r", 5, 0))),
        ("d1", "device_reading", "p", at, at, (None, None, None, None, None)),
    ]
    got = {r["event_id"]: r["features"] for r in feature_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["i1"]["acuity_code"], got["i1"]["modality_code"], got["i1"]["waiting_minutes"]) == (2, 3, 90)
    assert (got["i2"]["acuity_code"], got["i2"]["modality_code"]) == (3, 5)
    assert (got["l1"]["lab_value"], got["l1"]["abnormal_flag"]) == (2.5, 1)
    assert (got["r1"]["occupancy_ratio"], got["r1"]["occupied_count"]) == (0.75, 15)
    assert (got["r2"]["occupancy_ratio"], got["r2"]["occupied_count"]) == (-4.0, -4)
    assert got["d1"]["missing_ratio"] == 0.0 and got["d1"]["heart_rate"] is None


def test_flags_and_latest(spark):
    rows = [vital(i, "p", i * 1000, 80.0, 97.0, 15.0) for i in range(4)]
    late = rows[3][:4] + (rows[3][3] + timedelta(seconds=121),) + rows[3][5:]
    df = feature_vectors(spark.createDataFrame(rows[:3] + [late], SCHEMA))
    got = {r["event_id"]: r for r in df.collect()}
    assert [got[f"e{i:05}"]["insufficient_observations"] for i in range(4)] == [True, True, False, False]
    assert [got[f"e{i:05}"]["stale"] for i in range(4)] == [False, False, False, True]
    assert got["e00002"]["window_sizes"] == {"5m": 3}
    as_of = lambda s: F.lit(START + timedelta(seconds=s)).cast("timestamp")
    assert latest_features(df, as_of(10)).first()["event_id"] == "e00002"
    assert latest_features(df, as_of(125)).first()["event_id"] == "e00003"
    assert latest_features(df, as_of(245)).count() == 0
