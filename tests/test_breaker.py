"""The breaker at every call against a loop over the calls, for many partitions, models and settings."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tributary.operators.breaker import breaker_after, breaker_calls, call_outcomes
from tributary.operators.registry import Model, Registry
from tributary.settings import Settings

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
MODELS = ("risk_predictor", "capacity_forecaster", "anomaly_detector")
SCHEMA = "event_id string, model_name string, called_at timestamp, good boolean, note string"


def loop(calls, threshold, reset_s):
    """(event, model) -> (failures before, breaker), one call after the other."""
    states, out = {}, {}
    for event, model, at, ok, _ in sorted(calls, key=lambda c: (c[1], c[2], c[0])):
        failures, opened = states.get(model, (0, None))
        if opened is not None and at < opened + timedelta(seconds=reset_s):
            out[event, model] = (failures, "OPEN")
            continue
        out[event, model] = (failures, "CLOSED" if opened is None else "HALF_OPEN")
        failures = 0 if ok else min(threshold, failures + 1)
        states[model] = (failures, at if failures == threshold else None)
    return out


def calls(seed, n, fail, step_ms):
    """A hot model with most calls, outages in blocks, several calls at one instant, and calls long after."""
    rng, rows, ms = random.Random(seed), [], 0
    for i in range(n):
        ms += rng.choice([0, 0, step_ms, 3 * step_ms, 40 * step_ms if rng.random() < 0.05 else 0])
        model = MODELS[0] if rng.random() < 0.8 else rng.choice(MODELS[1:])
        bad = rng.random() < (0.95 if (i // 60) % 3 == 0 else fail)
        rows.append((f"e{i:06}", model, START + timedelta(milliseconds=ms), not bad, None if i % 7 else "x"))
    return rows


@pytest.mark.parametrize(
    "seed, threshold, reset_s, fail, step_ms, parts",
    [(1, 5, 15, 0.1, 400, 7), (2, 1, 15, 0.3, 900, 13), (3, 3, 2, 0.5, 100, 1), (4, 5, 600, 0.9, 700, 9), (5, 2, 1, 1.0, 250, 16)],
)
def test_every_call(spark, seed, threshold, reset_s, fail, step_ms, parts):
    rows = calls(seed, 900, fail, step_ms)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    merging = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # blocks stay as small as they come
    try:
        settings = Settings(breaker_threshold=threshold, breaker_reset_s=reset_s)
        df = breaker_calls(spark.createDataFrame(shuffled, SCHEMA), F.col("good"), settings=settings)
        got = {(r.event_id, r.model_name): (r.breaker_failures, r.breaker) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merging)
    want = loop(rows, threshold, reset_s)
    assert got == want
    assert {"OPEN", "HALF_OPEN", "CLOSED"} <= {state for _, state in want.values()}


@pytest.mark.parametrize("seed, threshold, reset_s", [(6, 5, 15), (7, 1, 400)])
def test_state_is_carried_on(spark, seed, threshold, reset_s):
    """Calls in lots by order, each going on from the state after the one before, are met as all at once."""
    rows = sorted(calls(seed, 600, 0.4, 500), key=lambda c: (c[2], c[0]))
    settings, state, got = Settings(breaker_threshold=threshold, breaker_reset_s=reset_s), None, {}
    for start in range(0, 600, 150):
        lot = spark.createDataFrame(rows[start : start + 150], SCHEMA)
        met = breaker_calls(lot, F.col("good"), settings=settings, before=state)
        got |= {(r.event_id, r.model_name): (r.breaker_failures, r.breaker) for r in met.collect()}
        after = breaker_after(met, F.col("good"), settings=settings, before=state)
        state = spark.createDataFrame(after.collect(), after.schema)
    assert got == loop(rows, threshold, reset_s)
    assert state.count() == len({r[1] for r in rows})


def test_odd_calls(spark):
    """Unregistered models go, null times come first, null outcomes fail, other columns stay, no rows give none."""
    rows = [
        ("a", "risk_predictor", None, None, "kept"),
        ("b", "risk_predictor", START, True, None),
        ("c", "unknown_model", START, False, None),
    ]
    settings = Settings(breaker_threshold=1)
    df = breaker_calls(spark.createDataFrame(rows, SCHEMA), F.col("good"), settings=settings)
    got = {r.event_id: (r.breaker, r.note, r.called_at is None) for r in df.collect()}
    assert got == {"a": ("CLOSED", "kept", True), "b": ("HALF_OPEN", None, False)}
    assert breaker_calls(spark.createDataFrame([], SCHEMA), F.col("good")).count() == 0


LOG = "event_id string, model_name string, called_at timestamp, latency_ms double, failed boolean, fallback_for string"


def test_fallback_is_called_for_lost_primaries_only(spark):
    """Five failures open the primary; refused calls go to the fallback too, whose breaker counts its own failures."""
    rows = []
    for i in range(10):
        at = START + timedelta(seconds=i)
        rows.append((f"e{i}", "anomaly_detector", at, 10.0, i < 7, None))
        rows.append((f"e{i}", "threshold_detector", at, 60.0 if i < 6 else 5.0, False, "anomaly_detector"))
    rows.append(("late", "anomaly_detector", START + timedelta(seconds=19), 10.0, False, None))
    rows.append(("late", "threshold_detector", START + timedelta(seconds=19), 5.0, False, "anomaly_detector"))
    made = call_outcomes(spark.createDataFrame(rows, LOG)).collect()
    by = lambda name: {r.event_id: r.outcome for r in made if r.model_name == name}
    assert by("anomaly_detector") == {
        **{f"e{i}": "error" for i in range(5)},
        **{f"e{i}": "circuit_open" for i in range(5, 10)},
        "late": "success",
    }
    # The fallback is over its 50 ms five times, and then refused as well.
    assert by("threshold_detector") == {
        **{f"e{i}": "timeout" for i in range(5)},
        **{f"e{i}": "circuit_open" for i in range(5, 10)},
    }


def test_fallbacks_in_a_circle(spark):
    circle = Registry(models=(Model("a", "1", fallback="b"), Model("b", "1", fallback="a")))
    with pytest.raises(ValueError, match="circle"):
        call_outcomes(spark.createDataFrame([], LOG), registry=circle)
