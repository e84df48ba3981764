"""One row per event, duplicate counts, quarantine replay and dimension upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.validate import check_events, quarantine_rows, valid_events
from tributary.settings import DEFAULTS, Settings


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key.

    The ``row_number() = 1`` filter lets Spark cut every key to one row inside each map task
    before the shuffle (WindowGroupLimit, partial and final), so a key with a third of all rows
    sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def dedup_events(events: DataFrame) -> DataFrame:
    """First arrival per event id (ties by source id)."""
    return keep_first(events, ["event_id"], [F.col("arrival_time"), F.col("source_id"), F.col("value")])


def duplicate_report(events: DataFrame) -> DataFrame:
    """Suppressed copies per event id; counted before the shuffle, so copies do not pile up."""
    return (
        events.groupBy("event_id")
        .agg((F.count("*") - 1).alias("suppressed"), F.countDistinct("source_id").alias("sources"))
        .filter("suppressed > 0")
    )


def replay_quarantine(
    quarantine: DataFrame,
    chosen: DataFrame,
    accepted: DataFrame,
    arrival_time,
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Send chosen quarantine records through validation again.

    ``chosen`` has the record ids (column ``id``). Returns (newly accepted events, new quarantine
    rows, the old quarantine table with ``replayed`` set). Records without a payload stay as they
    are; events that are already accepted are suppressed.
    """
    ids = chosen.select("id").distinct()
    again = (
        quarantine.filter(F.col("payload").isNotNull() & (F.col("payload") != ""))
        .join(ids, "id", "left_semi")
        .select(F.col("payload").alias("value"), arrival_time.alias("arrival_time"))
    )
    checked = check_events(again, settings)
    fresh = dedup_events(valid_events(checked)).join(accepted.select("event_id"), "event_id", "left_anti")
    marked = quarantine.join(ids.withColumn("_chosen", F.lit(True)), "id", "left").withColumn(
        "replayed", F.col("replayed") | (F.col("_chosen").isNotNull() & F.col("payload").isNotNull())
    )
    return fresh, quarantine_rows(checked), marked.drop("_chosen")


def upsert_dimension(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert rows whose key is not there yet; existing rows win."""
    fresh = keep_first(new, [key], [F.col(c) for c in new.columns if c != key])
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"))
