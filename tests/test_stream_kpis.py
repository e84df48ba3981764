"""KPIs of streams against the batch operators after every micro-batch, in any order of coming and over restarts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators.alerts import alert_lifecycle
from tributary.operators.reports import kpi_alerts_by_severity
from tributary.streaming.kpis import open_alerts_by_severity, run_model_stats, run_open_alerts, stored_model_stats, stream_open_alerts

ALERT = "id string, severity string, status string"
COMMAND = "alert_id string, command string, actor string, at timestamp, command_id string"


def test_open_alerts_go_down_on_commands(spark, tmp_path):
    """Commands before their alert, for no alert, twice; an alert that comes again; one already closed when it comes."""
    rng = random.Random(9)
    alerts = [(f"a{i}", rng.choice(["LOW", "HIGH", "CRITICAL"]), "OPEN") for i in range(40)] + [("done", "LOW", "RESOLVED")]
    commands = [(f"a{rng.randrange(60)}", rng.choice(["ack", "resolve"]), f"c{i}") for i in range(30)]
    lots = {"alerts": [[], [], []], "commands": [[], [], []]}
    for a in alerts:
        lots["alerts"][rng.choice([0, 0, 0, 1, 2])].append(a)
    for who, what, i in commands:
        lots["commands"][rng.choice([0, 1, 2, 2])].append((who, what, "x", None, i))
    lots["alerts"][2].append(lots["alerts"][0][0])
    kinds, seen, falls = {"alerts": ALERT, "commands": COMMAND}, {"alerts": [], "commands": []}, 0
    for n in range(3):
        streams = []
        for name, kind in kinds.items():
            seen[name] += lots[name][n]
            spark.createDataFrame(lots[name][n], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            streams.append(spark.readStream.schema(kind).parquet(str(tmp_path / name)))
        run_open_alerts(*streams, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        known = spark.createDataFrame(sorted(set(seen["alerts"])), ALERT)
        batch = kpi_alerts_by_severity(alert_lifecycle(known, spark.createDataFrame(seen["commands"], COMMAND)))
        got = open_alerts_by_severity(spark, str(tmp_path / "out"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
        falls += spark.read.parquet(str(tmp_path / "out")).filter("alerts < 0").count()
    assert falls  # some counts did go down


def test_model_stats_from_sketches(spark, tmp_path):
    """Counts and rates are exact; the quantile's rank is within the stated error, for latencies with and without ties."""
    rng = np.random.default_rng(3)
    kind = "model_name string, model_version string, status string, latency_ms double, created_at timestamp"
    rows = []
    for i in range(6000):
        model, tied = ("a", rng.integers(0, 7)) if i % 3 else ("b", rng.lognormal(3, 1))
        at = f"2024-01-{10 + i % 3} {i % 24:02d}:{i % 60:02d}:00"
        rows.append((model, "1", "success" if i % 7 else "error", None if i % 11 == 0 else float(tied), at))
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    schema = spark.createDataFrame([], kind).schema
    for start in range(0, 6000, 2000):
        lot = spark.createDataFrame(rows[start : start + 2000], kind.replace("created_at timestamp", "created_at string"))
        lot.withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        run_model_stats(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp")).awaitTermination()
    got = {r.model_name: r for r in stored_model_stats(spark, out).collect()}
    for model in "ab":
        mine = [r for r in rows if r[0] == model]
        assert got[model]["count"] == len(mine)
        assert got[model].success_rate == pytest.approx(sum(r[2] == "success" for r in mine) / len(mine), abs=5e-5)
        values = np.array([r[3] or 0.0 for r in mine])
        low, high = (values < got[model].p95_ms - 0.006).mean(), (values <= got[model].p95_ms + 0.006).mean()
        assert low <= 0.95 + 0.007 and high >= 0.95 - 0.007


def test_open_alerts_need_no_python_call_per_alert(spark, tmp_path):
    """The state is Spark's own aggregate; an alert that comes again with another severity, after its end or not, changes nothing."""
    lots = [
        ([("a", "LOW", "OPEN"), ("b", None, "OPEN"), ("c", "HIGH", None)], [("z", "ack", "x", None, "1")]),
        ([("a", "CRITICAL", "RESOLVED"), ("z", "HIGH", "OPEN")], [("b", "ack", "x", None, "2"), ("a", "note", "x", None, "3")]),
        ([("b", "HIGH", "OPEN")], [("a", "resolve", "x", None, "4"), ("a", "ack", "y", None, "5"), ("b", "resolve", "x", None, "6")]),
    ]
    want = [{("LOW", 1), (None, 1)}, {("LOW", 1)}, set()]
    for (alerts, commands), left in zip(lots, want):
        streams = []
        for name, kind, rows in (("alerts", ALERT, alerts), ("commands", COMMAND, commands)):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            streams.append(spark.readStream.schema(kind).parquet(str(tmp_path / name)))
        query = run_open_alerts(*streams, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        assert {tuple(r) for r in open_alerts_by_severity(spark, str(tmp_path / "out")).collect()} == left
    plan = stream_open_alerts(*streams)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Python" not in plan and "Pandas" not in plan
