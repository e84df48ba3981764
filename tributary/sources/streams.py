"""Reading raw messages and writing stages: files of JSON lines, parquet tables, or Kafka."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import partition_key
from tributary.schema import STAGES


def read_raw_events(
    spark: SparkSession,
    path_or_topic: str,
    streaming: bool = False,
    kafka_servers: str | None = None,
    arrival: Column | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """``value`` (one JSON text per message) and ``arrival_time``.

    A folder of JSON lines is read as text, a topic with the Kafka connector from its first offset.
    The arrival time of a file line is ``arrival`` (default: the file's modification time), that of a
    Kafka message its own timestamp.
    """
    reader = spark.readStream if streaming else spark.read
    if kafka_servers is not None:
        messages = (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", kafka_servers)
            .option("subscribe", path_or_topic)
            .option("startingOffsets", "earliest")
            .load()
        )
        return messages.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrival_time"))
    if streaming and files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.format("text").load(path_or_topic)
    when = F.col("_metadata.file_modification_time") if arrival is None else arrival
    return lines.select("value", when.alias("arrival_time"))


def stage_messages(df: DataFrame, stage: str) -> DataFrame:
    """Rows as keyed messages: topic, entity key and JSON value."""
    return df.select(
        F.lit(STAGES[stage]).alias("topic"),
        partition_key().alias("key"),
        F.to_json(F.struct(*df.columns)).alias("value"),
    )


def write_stage(df: DataFrame, folder: str, stage: str, checkpoint: str | None = None, kafka_servers: str | None = None):
    """Append a stage: to parquet partitioned by arrival date, or to Kafka.

    Returns the started query for a stream (which needs ``checkpoint``), None for a batch.
    """
    if kafka_servers is not None:
        messages = stage_messages(df, stage)
        writer = messages.writeStream if df.isStreaming else messages.write
        writer = writer.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
        if df.isStreaming:
            return writer.option("checkpointLocation", checkpoint).start()
        return writer.save()
    dated = df.withColumn("arrival_date", F.to_date("arrival_time"))
    target = f"{folder}/{stage}"
    if df.isStreaming:
        return (
            dated.writeStream.format("parquet")
            .partitionBy("arrival_date")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    return dated.write.mode("append").partitionBy("arrival_date").parquet(target)
