"""Replay of quarantine records on a stream: requests become messages of the raw stream again, each record once.

A request names a record (``id``) and the time it was made (``requested_at``), which is the message's new arrival time. Of
several requests for one record the first micro-batch's earliest counts; the ids asked for are keyed state. The
replay table under ``out`` holds the messages under ids that follow from the record alone; it is both the second source of
``run_events`` and the mark ``replayed`` of the records. A batch that runs again writes its own folder anew.

Requests for records that are not there, or have no text, leave nothing; a record must be stored before it is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.functions.columns import stable_id
from tributary.operators.dedup import keep_first

REPLAYS = "id string, quarantine_id string, event_id string, value string, arrival_time timestamp"


def run_replays(requests: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Requests against the table quarantine under ``out`` to the table replays beside it."""
    once = requests.select("id", "requested_at").dropDuplicates(["id"])

    def batch(rows: DataFrame, batch_id: int) -> None:
        held = rows.sparkSession.read.parquet(f"{out}/quarantine").filter(F.coalesce(F.col("payload"), F.lit("")) != "")
        # Copies of a message that came at one instant are records of one id: one of them is enough.
        found = keep_first(held.join(rows, "id").select("id", "event_id", "payload", "requested_at"), ["id"], [F.col("payload")])
        replays = found.select(
            stable_id("replay", F.col("id")).alias("id"),
            F.col("id").alias("quarantine_id"),
            "event_id",
            F.col("payload").alias("value"),
            F.col("requested_at").alias("arrival_time"),
        )
        target = replays.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        target.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/replays")

    writer = once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def replayed_messages(spark: SparkSession, out: str, files_per_batch: int | None = None) -> DataFrame:
    """The replays as raw messages, to be united with the raw stream."""
    reader = spark.readStream.schema(REPLAYS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{out}/replays").select("value", "arrival_time")


def marked_quarantine(spark: SparkSession, out: str) -> DataFrame:
    """The quarantine records with ``replayed`` as the replays so far have it."""
    held = spark.read.parquet(f"{out}/quarantine")
    marks = spark.read.schema(REPLAYS).parquet(f"{out}/replays").select(F.col("quarantine_id").alias("id")).distinct()
    joined = held.join(marks.withColumn("_mark", F.lit(True)), "id", "left")
    return joined.withColumn("replayed", F.col("replayed") | F.col("_mark").isNotNull()).drop("_mark")
