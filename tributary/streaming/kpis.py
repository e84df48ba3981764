"""KPIs that a stream keeps up to date: open alerts by severity with retractions, and statistics per model as mergeable parts.

Each micro-batch stores what it changed under its own number, a few rows whatever its size; a batch that runs again replaces
them. Reading adds the parts up, so a KPI costs as many rows as there were batches and labels (or minutes and models).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.functions.columns import round_even
from tributary.operators.reports import MODEL_QUANTILE, OPEN_STATES

_CHANGE = "severity string, alerts bigint"
# Size of a sketch: with 400 items the normalised rank error of one quantile is below 0.7 %, 99 % of the time.
SKETCH_ITEMS = 400


def stream_open_alerts(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Changes of the number of open alerts per severity: +1 when an alert opens, -1 when a command ends that (update mode).

    ``alerts`` has id, severity and status; an acknowledgement or a resolve closes it for these counts, also one that came before the
    alert, so the order of coming does not matter. The state per alert is narrow and never dropped: the micro-batches in which the
    alert and its first command came, known by their time, which Spark keeps with the batch's offsets and which grows from batch
    to batch. An alert that comes again keeps what its first micro-batch said. Each change leaves in the batch that makes it.
    """
    raised = alerts.select("id", "severity", "status", F.lit(None).cast("string").alias("command"))
    given = commands.filter(F.col("command").isin("ack", "resolve")).select(
        F.col("alert_id").alias("id"), *[F.lit(None).cast("string").alias(c) for c in ("severity", "status")], "command"
    )
    closed = ~F.coalesce(F.col("status").isin(*OPEN_STATES), F.lit(False))
    came, now = F.col("command").isNull(), F.col("_now")
    rows = raised.unionByName(given).withColumn("_now", F.current_timestamp())  # one instant per micro-batch
    state = rows.groupBy("id").agg(
        F.min(F.when(came, F.struct(now.alias("at"), closed.alias("closed")))).alias("raised"),
        F.min(F.when(came, F.struct(now.alias("at"), F.coalesce("severity", F.lit("")).alias("severity")))).alias("first"),
        F.min(F.when(~came, now)).alias("ended"),
    )
    opens = F.coalesce(~F.col("raised.closed"), F.lit(False))
    before = opens & (F.col("raised.at") < now) & F.coalesce(F.col("ended") >= now, F.lit(True))
    after = opens & F.col("ended").isNull()
    changed = state.withColumn("_now", F.current_timestamp()).select(F.nullif(F.col("first.severity"), F.lit("")).alias("severity"), before.alias("before"), after.alias("after"))
    return changed.filter("before != after").select("severity", F.when(F.col("after"), 1).otherwise(-1).cast("bigint").alias("alerts"))


def _run(rows: DataFrame, made: Any, out: str, checkpoint: str, trigger: dict | None, mode: str = "append") -> StreamingQuery:
    def batch(part: DataFrame, batch_id: int) -> None:
        numbered = made(part).withColumn("batch_id", F.lit(batch_id))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    writer = rows.writeStream.outputMode(mode).foreachBatch(batch)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_open_alerts(
    alerts: DataFrame, commands: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Stores each micro-batch's change per severity."""

    def made(changes: DataFrame) -> DataFrame:
        return changes.groupBy("severity").agg(F.sum("alerts").alias("alerts"))

    return _run(stream_open_alerts(alerts, commands), made, out, checkpoint, trigger, "update")


def open_alerts_by_severity(spark: SparkSession, out: str) -> DataFrame:
    """``reports.kpi_alerts_by_severity`` after all micro-batches so far; their sum is ``kpi_open_alerts``."""
    stored = spark.read.schema(f"{_CHANGE}, batch_id int").parquet(out)
    return stored.groupBy("severity").agg(F.sum("alerts").alias("alerts")).filter("alerts > 0")


def run_model_stats(predictions: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stores rows, successes and a sketch of the latencies per model, version and minute of each micro-batch."""

    def made(rows: DataFrame) -> DataFrame:
        minute = F.date_trunc("minute", F.col("created_at"))
        return rows.groupBy("model_name", "model_version", minute.alias("minute")).agg(
            F.count("*").alias("count"),
            F.count_if(F.col("status") == "success").alias("ok"),
            F.kll_sketch_agg_double(F.coalesce("latency_ms", F.lit(0.0)), F.lit(SKETCH_ITEMS)).alias("sketch"),
        )

    return _run(predictions, made, out, checkpoint, trigger)


def stored_model_stats(spark: SparkSession, out: str) -> DataFrame:
    """``reports.model_stats`` over all micro-batches so far; ``p95_ms`` by sketch, the rest exact.

    Sketches merge as sums do, before the shuffle and after it.
    """
    keys = ["model_name", "model_version"]
    whole = spark.read.parquet(out).groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("ok").alias("ok"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_ITEMS)).alias("sketch")
    )
    p95 = F.kll_sketch_get_quantile_double("sketch", F.lit(MODEL_QUANTILE))
    return whole.withColumn("_rate", F.col("ok") / F.col("count")).withColumn("_p95", p95).select(
        *keys, "count", round_even(F.col("_rate"), 4).alias("success_rate"), round_even(F.col("_p95"), 2).alias("p95_ms")
    )
