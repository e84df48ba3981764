"""The streams give what the batch operators give on the same messages."""

import random
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from tributary.operators.alerts import alert_lifecycle, open_alerts
from tributary.operators.dedup import dedup_events
from tributary.operators.decisions import decide
from tributary.operators.features import feature_vectors
from tributary.operators.scoring import predict
from tributary.operators.validate import check_events, quarantine_rows, valid_events
from tributary.plans import flow
from tributary.sources.streams import read_raw_events, write_stage
from tributary.sources.tables import wire_events
from tributary.streaming.stages import alert_states, kpis, run_alert_lifecycle, run_alerts, run_events, run_kpis, run_quarantine, stream_dedup

RAW = "value string, arrival_time timestamp"


def _messages(spark, sf):
    """Raw messages in four files in the order of their timestamps."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raw = wire_events(spark, sf)
    order = F.regexp_extract("value", r'"event_id":"evt_(\d+)"', 1).cast("int")
    part = F.ntile(4).over(Window.orderBy(order))
    raw.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/parts")
    for i in range(1, 5):
        spark.read.schema(RAW).parquet(f"{folder}/parts/part={i}").coalesce(1).write.mode("append").parquet(f"{folder}/raw")
    return folder, raw


def _keys(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_stream_equals_batch(spark, sf):
    folder, raw = _messages(spark, sf)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/raw")
    out = f"{folder}/out"
    query = run_events(stream, out, f"{folder}/cp", flow.fixed_scorers(), flow.WIDE, flow.with_fixed_raw)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    run_quarantine(stream, out, f"{folder}/cp-quarantine", flow.WIDE).awaitTermination()

    checked = check_events(raw)
    events = dedup_events(valid_events(checked))
    made = decide(predict(flow.with_fixed_raw(feature_vectors(events, flow.WIDE)), flow.fixed_scorers()))
    assert _keys(spark.read.parquet(f"{out}/accepted"), "event_id") == _keys(events, "event_id")
    assert _keys(spark.read.parquet(f"{out}/quarantine"), "id", "failure_code") == _keys(
        quarantine_rows(checked), "id", "failure_code"
    )
    features = feature_vectors(events, flow.WIDE)
    vectors, names = spark.read.parquet(f"{out}/vectors"), [c for c in features.columns if c not in ("attributes", "value", "features", "window_sizes")]
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in features.select("features.*").dtypes]
    whole = [*names, F.col("window_sizes")["5m"].alias("window_5m"), F.struct(*[F.col(f"features.{c}") for c in features.schema["features"].dataType.names]).alias("f")]
    got, want = (_keys(df.select(*whole).select(*names, "window_5m", "f.*").select(*names, "window_5m", *rounded), "*") for df in (vectors, features))
    assert got == want
    shown = ["event_id", "severity", "action", "decision_score", "confidence"]
    assert _keys(spark.read.parquet(f"{out}/decisions"), *shown) == _keys(made, *shown)
    n = made.select(F.sum(F.size("predictions"))).first()[0]
    assert spark.read.parquet(f"{out}/predictions").count() == n

    run_alerts(spark, out, f"{folder}/cp-alerts", flow.WIDE).awaitTermination()
    assert _keys(spark.read.parquet(f"{out}/alerts"), "dedup_key") == _keys(open_alerts(made), "dedup_key")


def test_copies_in_later_batches_are_suppressed(spark, sf):
    folder, raw = _messages(spark, sf)
    # The same files once more: every message has been seen.
    spark.read.schema(RAW).parquet(f"{folder}/raw").coalesce(1).write.mode("append").parquet(f"{folder}/raw")
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 2).parquet(f"{folder}/raw")
    query = run_events(stream, f"{folder}/out", f"{folder}/cp", flow.fixed_scorers(), flow.WIDE, flow.with_fixed_raw)
    query.awaitTermination()
    accepted = spark.read.parquet(f"{folder}/out/accepted")
    assert accepted.count() == accepted.select("event_id").distinct().count()
    assert accepted.count() == dedup_events(valid_events(check_events(raw))).count()


def test_stateful_dedup_and_kpis(spark, sf):
    folder, raw = _messages(spark, sf)
    stream = spark.readStream.schema(RAW).parquet(f"{folder}/raw")
    valid = valid_events(check_events(stream))
    target = f"{folder}/dedup"
    write = stream_dedup(valid).select("event_id", "source_id", "arrival_time", "value").writeStream.format("parquet").option("path", target)
    write.option("checkpointLocation", f"{folder}/cp1").trigger(availableNow=True).start().awaitTermination()
    batch = dedup_events(valid_events(check_events(raw)))
    shown = ["event_id", "source_id", "arrival_time", "value"]  # the first of the copies that come in one micro-batch
    assert _keys(spark.read.parquet(target), *shown) == _keys(batch, *shown)

    late = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/raw")
    run_kpis(valid_events(check_events(late)), f"{folder}/kpis", f"{folder}/cp2").awaitTermination()
    got = _keys(kpis(spark, f"{folder}/kpis"), "window_start", "events", "patients")
    every = valid_events(check_events(raw)).groupBy(F.window("arrival_time", "1 minute").start.alias("window_start"))
    assert got == _keys(every.agg(F.count("*").alias("events"), F.countDistinct(F.nullif("patient_id", F.lit(""))).alias("patients")), "window_start", "events", "patients")


def _vital(spark, event_id, day, spo2):
    value = f"""{{"event_id":"{event_id}","source_id":"bedside_4","event_type":"patient_vital","patient_id":"pat_7","device_id":"bedside_4",
        "timestamp":"{day}T10:00:00+00:00","schema_version":1,"payload":{{"spo2":{spo2}}},"trace_id":"trace_{event_id}"}}"""
    return spark.createDataFrame([(value, f"{day} 10:00:20")], "value string, at string").selectExpr("value", "cast(at as timestamp) arrival_time")


def test_late_arrivals_and_reused_ids_over_batches(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    days = [("evt_a", "2024-01-20"), ("evt_b", "2024-01-10"), ("evt_a", "2024-01-17"), ("evt_c", "2024-01-20")]
    for event_id, day in days:  # one message per micro-batch, in this order
        _vital(spark, event_id, day, 85).write.mode("append").parquet(f"{folder}/raw")
        raw = spark.readStream.schema(RAW).parquet(f"{folder}/raw")
        run_events(raw, f"{folder}/out", f"{folder}/cp", flow.fixed_scorers(), flow.WIDE, flow.with_fixed_raw).awaitTermination()
        run_alerts(spark, f"{folder}/out", f"{folder}/alerts-cp", flow.WIDE).awaitTermination()
    accepted = spark.read.parquet(f"{folder}/out/accepted")
    assert sorted(r.event_id for r in accepted.collect()) == ["evt_a", "evt_b", "evt_c"]
    assert spark.read.parquet(f"{folder}/out/decisions").count() == 3
    alerts = spark.read.parquet(f"{folder}/out/alerts")
    assert sorted(r.event_id for r in alerts.collect()) == ["evt_a", "evt_b"]  # evt_c falls into evt_a's bucket


def test_json_lines_source_and_stage_sink(spark, sf):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raw = wire_events(spark, sf)
    raw.select("value").write.text(f"{folder}/lines")
    lines = read_raw_events(spark, f"{folder}/lines", arrival=F.lit("2024-01-10").cast("timestamp"))
    assert lines.columns == ["value", "arrival_time"]
    assert lines.count() == raw.count()
    events = dedup_events(valid_events(check_events(raw)))
    write_stage(events, folder, "validated")
    back = spark.read.parquet(f"{folder}/validated")
    assert back.count() == events.count()
    assert "arrival_date" in back.columns

    streamed = read_raw_events(
        spark, f"{folder}/lines", streaming=True, arrival=F.lit("2024-01-10").cast("timestamp"), files_per_batch=1
    )
    write_stage(streamed, folder, "raw", checkpoint=f"{folder}/cp").awaitTermination()
    assert spark.read.parquet(f"{folder}/raw").count() == raw.count()


def test_alert_lifecycle_in_any_order_of_coming(spark):
    """Alerts and commands dealt over micro-batches at random leave what the batch operator gives; commands come before their alert,
    alerts without commands and commands without an alert are among them, and a restart goes on from the state."""
    rng = random.Random(4)
    alerts = [(f"a{i}", "OPEN") for i in range(12)] + [("quiet", "OPEN")]
    commands = []
    for i in range(60):
        who, at = f"a{rng.randrange(14)}", f"2024-01-10 10:00:{rng.randrange(20):02d}"
        commands.append((who, rng.choice(["ack", "ack", "resolve"]), rng.choice("xyz"), at, f"c{i}"))
    kinds = {"alerts": "id string, status string", "commands": "alert_id string, command string, actor string, at string, command_id string"}
    frames = {"alerts": spark.createDataFrame(alerts, kinds["alerts"])}
    frames["commands"] = spark.createDataFrame(commands, kinds["commands"]).withColumn("at", F.col("at").cast("timestamp"))
    shown = ["id", "status", "acknowledged_at", "acknowledged_by", "resolved_at"]
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    dealt = {name: df.withColumn("batch", (F.abs(F.xxhash64(*df.columns)) % 3)).cache() for name, df in frames.items()}
    for i in range(3):  # one micro-batch each, the query started again every time
        streams = []
        for name, df in dealt.items():
            df.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
            streams.append(spark.readStream.schema(frames[name].schema).parquet(f"{folder}/{name}"))
        run_alert_lifecycle(*streams, f"{folder}/states", f"{folder}/cp").awaitTermination()
        so_far = {name: df.filter(F.col("batch") <= i).drop("batch") for name, df in dealt.items()}
        assert _keys(alert_states(spark, f"{folder}/states"), *shown) == _keys(alert_lifecycle(so_far["alerts"], so_far["commands"]), *shown)
    done = alert_states(spark, f"{folder}/states")
    assert done.count() == 13 and {r.status for r in done.collect()} == {"ACKNOWLEDGED", "OPEN", "RESOLVED"}
