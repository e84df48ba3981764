"""Counters, histograms and rates over the stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.settings import DEFAULTS, Settings

# Upper bounds of the histogram buckets, in seconds.
MODEL_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.5, 1.0)
STAGE_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0)
END_TO_END_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)


def counter_by_label(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows per label combination (combined before the shuffle)."""
    return df.groupBy(*labels).agg(F.count("*").alias("count"))


def call_counter(made: DataFrame) -> DataFrame:
    """Calls per model and outcome, a replaced primary's own call included, and how many of them were fallback calls."""
    return made.groupBy("model_name", "outcome").agg(
        F.count("*").alias("calls"), F.count("fallback_for").alias("as_fallback")
    )


def _bucket_counts(value: Column, buckets: tuple[float, ...]) -> list[Column]:
    """Cumulative counts per upper bound, then all rows: one aggregate each, in one pass."""
    return [F.count_if(value <= F.lit(b)).alias(f"_le{i}") for i, b in enumerate(buckets)] + [
        F.count(value).alias("_all")
    ]


def latency_histogram(df: DataFrame, labels: list[str], seconds: Column, buckets: tuple[float, ...]) -> DataFrame:
    """Cumulative buckets per label, one row per bound, with +Inf last.

    The bounds become conditional counts of one aggregation; no row is multiplied by the bounds.
    """
    counts = df.groupBy(*labels).agg(*_bucket_counts(seconds, buckets))
    pairs = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"_le{i}").alias("count")) for i, b in enumerate(buckets)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("count"))]
    return counts.select(*labels, F.inline(F.array(*pairs)))


def counter_rate(df: DataFrame, labels: list[str], at: str, window: str = "1 minute", step: str = "15 seconds") -> DataFrame:
    """Per-second rate over a sliding window.

    Events are first counted per step; only those counts are handed to the overlapping windows.
    """
    per_step = df.groupBy(*labels, F.window(at, step).alias("_step")).agg(F.count("*").alias("_n"))
    sliding = per_step.groupBy(*labels, F.window(F.col("_step.start"), window, step).alias("w")).agg(
        F.sum("_n").alias("n")
    )
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / F.lit(1_000_000.0)
    return sliding.select(*labels, F.col("w.start").alias("window_start"), (F.col("n") / seconds).alias("rate"))


def histogram_quantile(
    df: DataFrame, labels: list[str], at: str, seconds: Column, buckets: tuple[float, ...], q: float, window: str
) -> DataFrame:
    """Quantile estimated from buckets per label and window, linear inside the bucket.

    The first bucket starts at 0; a quantile beyond the last bound is that bound.
    """
    counts = df.groupBy(*labels, F.window(at, window).alias("w")).agg(*_bucket_counts(seconds, buckets))
    wanted = F.col("_all") * F.lit(q)
    value = F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        low = F.lit(float(buckets[i - 1]) if i else 0.0)
        below = F.col(f"_le{i - 1}") if i else F.lit(0)
        inside = F.col(f"_le{i}") - below
        linear = low + (F.lit(float(buckets[i])) - low) * ((wanted - below) / inside)
        value = F.when((F.col(f"_le{i}") >= wanted) & (inside > 0), linear).otherwise(value)
    return counts.filter(F.col("_all") > 0).select(
        *labels, F.col("w.start").alias("window_start"), value.alias("quantile")
    )


def quota_flag(requests: DataFrame, user: str, at: str, tie: str, settings: Settings = DEFAULTS, per_s: int = 60) -> DataFrame:
    """Number, remaining quota and verdict of each request within its user's window.

    A request's number is its rank in its own part of the window plus the requests of the earlier
    parts. Parts are counted before the shuffle, so one user's window is spread over several groups.
    """
    limit = settings.requests_per_minute
    parts = 60
    micros = F.unix_micros(at)
    marked = requests.withColumns(
        {
            "_minute": F.floor(micros / F.lit(per_s * 1_000_000)),
            "_part": F.floor(F.pmod(micros, F.lit(per_s * 1_000_000)) / F.lit(per_s * 1_000_000 / parts)),
        }
    )
    cell = [user, "_minute", "_part"]
    counts = marked.groupBy(*cell).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(user, "_minute").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = Window.partitionBy(*cell).orderBy(at, tie)
    ranked = marked.withColumn("_rank", F.row_number().over(own)).join(offsets, cell)
    number = (F.col("_rank") + F.col("_before")).cast("bigint")
    return ranked.select(
        user,
        tie,
        at,
        number.alias("request_number"),
        F.greatest(F.lit(0).cast("bigint"), F.lit(limit) - number).alias("remaining"),
        (number > limit).alias("refused"),
    )
