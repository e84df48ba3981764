"""Replays on a stream: each record once whatever is asked how often, marks that follow, and the batch operator's outcome."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tributary.operators.validate import check_events, quarantine_rows, valid_events
from tributary.sources.tables import wire_events
from tributary.streaming.replay import marked_quarantine, replayed_messages, run_replays
from tributary.streaming.stages import stream_dedup, stream_validate

LATER = datetime(2024, 1, 20, tzinfo=timezone.utc)
REQUEST = "id string, requested_at timestamp"


def test_each_record_is_replayed_once(spark, sf, tmp_path):
    out, asked = str(tmp_path / "out"), str(tmp_path / "asked")
    held = quarantine_rows(check_events(wire_events(spark, sf)))
    held.withColumns({"day": F.to_date("created_at"), "batch_id": F.lit(0)}).write.partitionBy("day", "batch_id").parquet(f"{out}/quarantine")
    empty = held.limit(1).withColumns({"id": F.lit("no-text"), "payload": F.lit(""), "day": F.to_date("created_at"), "batch_id": F.lit(1)})
    empty.write.mode("append").partitionBy("day", "batch_id").parquet(f"{out}/quarantine")
    clock = sorted(r.id for r in held.filter("failure_code = 'CLOCK_SKEW'").select("id").distinct().collect())
    assert len(clock) > 4
    lots = [clock[:3] + clock[:2] + ["unknown", "no-text"], clock[1:5], clock[:5]]
    for n, lot in enumerate(lots):
        rows = [(i, LATER + timedelta(hours=n)) for i in lot]
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(asked)
        # A new query for each lot: ids asked for come from its checkpoint.
        run_replays(spark.readStream.schema(REQUEST).parquet(asked), out, str(tmp_path / "cp")).awaitTermination()
    replays = spark.read.parquet(f"{out}/replays").collect()
    assert sorted(r.quarantine_id for r in replays) == clock[:5]
    assert {r.quarantine_id: r.batch_id for r in replays} == {**dict.fromkeys(clock[:3], 0), **dict.fromkeys(clock[3:5], 1)}
    assert len({r.id for r in replays}) == 5
    marked = {r.id: r.replayed for r in marked_quarantine(spark, out).select("id", "replayed").distinct().collect()}
    assert {i for i, mark in marked.items() if mark} == set(clock[:5]) and "no-text" in marked

    # The messages go through validation and the known ids like any other.
    events = stream_dedup(valid_events(stream_validate(replayed_messages(spark, out))))
    query = events.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp2"))
    query.trigger(availableNow=True).start().awaitTermination()
    again = held.filter(F.col("id").isin(clock[:5])).select("id", "payload").distinct()
    want = valid_events(check_events(again.select(F.col("payload").alias("value"), F.lit(LATER).alias("arrival_time"))))
    got = [r.event_id for r in spark.table("replayed").collect()]
    assert sorted(got) == sorted(r.event_id for r in want.select("event_id").distinct().collect())
