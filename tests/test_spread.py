"""Work per message is dealt to many tasks by rows, however few bytes or files the tables have."""

import os
import re

from pyspark.sql import functions as F

from tributary.plans import flow, queries
from tributary.sources import tables


def test_messages_are_dealt_by_rows(spark, sf, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert tables.wire_events(spark, sf).rdd.getNumPartitions() == cores
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 5)
    rows = tables.table(spark, sf, "events").count()
    assert tables.wire_events(spark, sf).rdd.getNumPartitions() == -(-rows // 5) > cores


def test_a_lot_of_messages_has_many_files(spark, sf, tmp_path):
    flow.write_lots(spark, sf, str(tmp_path / "lots"))
    lots = spark.read.parquet(str(tmp_path / "lots")).withColumn("file", F.input_file_name())
    cores = spark.sparkContext.defaultParallelism
    files = lots.groupBy("part").agg(F.countDistinct("file").alias("files")).collect()
    assert {r.part: r.files for r in files} == {i: cores for i in range(3)}


def test_messages_are_parsed_once_for_events_and_quarantine(spark, sf):
    files = [set(df.inputFiles()) for df in (flow.checked(spark, sf), flow.valid(spark, sf))]
    assert files[0] == files[1] and all("-checked/" in f for f in files[0])
    assert set(flow.checked(spark, sf).inputFiles()) == files[0]


def test_state_of_streams_is_dealt_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    wanted = tables.spread_partitions(tables.table(spark, sf, "events"))
    monkeypatch.setattr(flow, "_WRITTEN", {})
    folder = flow.stream_tables(spark, sf)
    stores = [name for name in os.listdir(f"{folder}/checkpoint/state/0") if name.isdigit()]
    assert len(stores) == wanted != int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.read.parquet(f"{folder}/accepted").count() == flow.accepted(spark, sf).count()


def test_state_of_replays_is_dealt_by_rows(spark, sf):
    folder, wanted = queries._stream_replayed(spark, sf), tables.spread_partitions(tables.table(spark, sf, "events"))
    for checkpoint in ("checkpoint", "checkpoint-replays"):
        stores = [name for name in os.listdir(f"{folder}/{checkpoint}/state/0") if name.isdigit()]
        assert len(stores) == wanted != int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_history_as_of_arrival_is_dealt_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 90)
    wanted = tables.spread_partitions(tables.table(spark, sf, "events"))
    plan = queries.QUERIES["history_as_of_arrival"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"RepartitionByExpression \[history_key#\d+, event_type#\d+, _slice#\d+L?\], {wanted}\b", plan)


def test_stage_tables_are_dealt_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(flow, "_WRITTEN", {})
    wanted = tables.spread_partitions(tables.table(spark, sf, "events"))
    names = ("spark.sql.files.minPartitionNum", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(name, None) for name in names]
    for stage in (flow.checked, flow.accepted, flow.vectors):
        assert len(stage(spark, sf).inputFiles()) == wanted, stage.__name__
    assert [spark.conf.get(name, None) for name in names] == before
