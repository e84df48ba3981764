"""The stored latest vectors against the batch operator after every micro-batch, with compaction, restarts and a crash."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tributary.operators.features import latest_features
from tributary.settings import Settings
from tributary.streaming.snapshot import BUCKETS, _complete, compact, run_latest_features, stored_latest_features

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "event_id string, patient_id string, arrival_time timestamp, features struct<heart_rate:double>"


def lots():
    """Five lots of vectors, late ones and ties among them; a hot patient, and rows without one."""
    rng, rows = random.Random(4), []
    for i in range(500):
        patient = "hot" if i % 3 == 0 else rng.choice([None, "", *[f"p{k}" for k in range(60)]])
        at = START + timedelta(seconds=i // 2 + rng.choice([0, 0, 0, 70]))
        rows.append((f"e{i:04}", patient, at, (float(i),)))
    return [rows[i : i + 100] for i in range(0, 500, 100)]


def test_stored_equals_batch_after_every_batch(spark, tmp_path):
    folder, source, seen = str(tmp_path / "latest"), str(tmp_path / "source"), []
    settings = Settings(feature_ttl_s=90)
    schema = spark.createDataFrame([], SCHEMA).schema
    key = lambda df: sorted((r.patient_id, r.event_id, r.features[0]) for r in df.collect())
    for n, lot in enumerate(lots()):
        seen += lot
        spark.createDataFrame(lot, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)  # a new query each time, from its checkpoint
        run_latest_features(stream, folder, str(tmp_path / "checkpoint"), settings, compact_every=2).awaitTermination()
        now = F.lit(max(r[2] for r in seen) + timedelta(seconds=n)).cast("timestamp")
        want = key(latest_features(spark.createDataFrame(seen, SCHEMA), now, settings))
        assert want and key(stored_latest_features(spark, folder, schema, now, settings=settings)) == want
        one = want[len(want) // 2]
        assert key(stored_latest_features(spark, folder, schema, now, one[0], settings)) == [one]
    assert _complete(spark, f"{folder}/base", "upto") == [1, 3]
    assert _complete(spark, f"{folder}/delta", "batch_id") == [2, 3, 4]  # what an earlier base holds is gone

    # A base that was not written to the end is not read, and compacting again changes nothing.
    (tmp_path / "latest" / "base" / "upto=9").mkdir()
    compact(spark, folder, 4, schema, settings)
    compact(spark, folder, 4, schema, settings)
    assert key(stored_latest_features(spark, folder, schema, now, settings=settings)) == want


def test_one_patient_reads_one_bucket(spark, tmp_path):
    folder, source = str(tmp_path / "latest"), str(tmp_path / "source")
    spark.createDataFrame([r for lot in lots() for r in lot], SCHEMA).write.parquet(source)
    run_latest_features(spark.readStream.schema(SCHEMA).parquet(source), folder, str(tmp_path / "cp")).awaitTermination()
    schema = spark.createDataFrame([], SCHEMA).schema
    read = stored_latest_features(spark, folder, schema, F.lit(START).cast("timestamp"), "p7")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    used = spark.read.parquet(f"{folder}/delta/batch_id=0").select("bucket").distinct().count()
    assert 10 < used <= BUCKETS


def test_nothing_stored(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    assert stored_latest_features(spark, str(tmp_path / "none"), schema, F.lit(START).cast("timestamp")).count() == 0
