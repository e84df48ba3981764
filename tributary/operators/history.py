"""Rolling event-time history per entity, linear in the rows and spread over time slices.

The window of an event at time t holds the events of the same patient and type in [t - w, t], both
ends included, itself included. A plain ``Window.partitionBy(patient, type).rangeBetween(-w, 0)``
has two weak points at scale: one busy patient is one task, and Spark walks the whole frame again
for every row. Here time is cut into slices of width s with w = m * s, and the window of an event in
slice j is put together from three mergeable summaries:

* the events of its own slice up to t            (running from the slice's start),
* the events of slice j - m from t - w on        (running from that slice's end),
* all events of the slices between               (one summary row per slice; empty when m = 1).

Each event is sent to its own slice and, with its few measured columns only, to slice j + m. Both
running parts then are growing frames over one shuffle by (entity, type, slice), so the cost per row
does not depend on how many events a window holds, and an entity with a third of all rows is spread
over as many groups as it has slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.columns import first_non_blank

ENTITY = ["history_key", "event_type"]

# Variance is summed around this value, near which heart rates lie, to keep the squares small.
_HR_CENTRE = 80.0


@dataclass(frozen=True)
class Measure:
    """A mergeable summary: ``how`` is sum, min or max, over ``value`` (null values are left out)."""

    name: str
    how: str
    value: Column


def vital_and_bed_measures() -> list[Measure]:
    vital, bed = F.col("attributes.patient_vital"), F.col("attributes.bed_status")
    hr, spo2, rr = vital["heart_rate"], vital["spo2"], vital["respiratory_rate"]
    offset = hr - _HR_CENTRE
    when_ms = F.unix_millis("event_time")

    def timed(value: Column) -> Column:
        return F.when(
            value.isNotNull(), F.struct(when_ms.alias("at"), F.col("event_id").alias("id"), value.alias("value"))
        )

    def present(value: Column) -> Column:
        return F.when(value.isNotNull(), F.lit(1).cast("bigint"))

    return [
        Measure("events", "sum", F.lit(1).cast("bigint")),
        Measure("hr_n", "sum", present(hr)),
        Measure("hr_offset", "sum", offset),
        Measure("hr_square", "sum", offset * offset),
        Measure("hr_min", "min", hr),
        Measure("hr_max", "max", hr),
        Measure("hr_first", "min", timed(hr)),
        Measure("hr_last", "max", timed(hr)),
        Measure("spo2_n", "sum", present(spo2)),
        Measure("spo2_sum", "sum", spo2),
        Measure("spo2_min", "min", spo2),
        Measure("spo2_first", "min", timed(spo2)),
        Measure("rr_n", "sum", present(rr)),
        Measure("rr_sum", "sum", rr),
        Measure("occupied", "sum", F.when(bed["status"] == "occupied", F.lit(1).cast("bigint"))),
        Measure("available", "sum", F.when(bed["status"] == "available", F.lit(1).cast("bigint"))),
        Measure("ratio_n", "sum", present(bed["occupancy_ratio"])),
        Measure("ratio_sum", "sum", bed["occupancy_ratio"]),
    ]


_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(how: str, parts: list[Column]) -> Column:
    if how == "min":
        return F.least(*parts)
    if how == "max":
        return F.greatest(*parts)
    total = F.coalesce(parts[0], parts[0] * 0, F.lit(0))
    for part in parts[1:]:
        total = total + F.coalesce(part, F.lit(0))
    return total


def slice_width(window_ms: int, slice_ms: int | None) -> int:
    """A divisor of the window, at most ``slice_ms`` wide (default: the window for five minutes, else 1/24)."""
    target = slice_ms or max(300_000, window_ms // 24)
    parts = -(-window_ms // min(target, window_ms))
    while window_ms % parts:
        parts += 1
    return window_ms // parts


def with_history(
    events: DataFrame, window_ms: int, slice_ms: int | None = None, measures: list[Measure] | None = None
) -> DataFrame:
    """Add ``history``: a struct with every measure summed up over each event's window.

    Events without a patient have no history but themselves; their key is their own id, so they do
    not meet in one null group.
    """
    measures = measures or vital_and_bed_measures()
    width = slice_width(window_ms, slice_ms)
    between = window_ms // width - 1
    patient = first_non_blank(F.col("patient_id"))
    columns = events.columns
    keyed = events.withColumns(
        {
            "history_key": F.coalesce(F.concat(F.lit("p:"), patient), F.concat(F.lit("e:"), F.col("event_id"))),
            "_at": F.unix_millis("event_time"),
            **{f"_m_{m.name}": m.value for m in measures},
        }
    ).withColumn("_slice", F.floor(F.col("_at") / F.lit(width)))

    # own = True: the event in its slice; False: its measures as the tail of a window m slices later.
    # An event without a patient is never in another event's window.
    copies = F.when(patient.isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    sent = keyed.withColumn("_own", F.explode(copies))
    own = F.col("_own")
    narrow = {"event_type", "history_key"}
    sent = sent.select(
        *ENTITY,
        "_own",
        F.when(own, F.col("_slice")).otherwise(F.col("_slice") + between + 1).alias("_slice"),
        F.when(own, F.col("_at")).otherwise(F.col("_at") + window_ms).alias("_pos"),
        *[f"_m_{m.name}" for m in measures],
        *[F.when(own, F.col(c)).alias(c) for c in columns if c not in narrow],
    )
    cell = [*ENTITY, "_slice"]
    forward = Window.partitionBy(*cell).orderBy(F.col("_pos")).rangeBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*cell).orderBy(F.col("_pos").desc()).rangeBetween(Window.unboundedPreceding, 0)
    parts = {}
    for m in measures:
        value, how = F.col(f"_m_{m.name}"), _AGGREGATE[m.how]
        parts[f"_head_{m.name}"] = how(F.when(own, value)).over(forward)
        parts[f"_tail_{m.name}"] = how(F.when(~own, value)).over(backward)
    ranged = sent.withColumns(parts).filter(own)
    sources = ["head", "tail"]

    if between:
        # One row per entity and slice, summed up before the shuffle; then the slices between.
        per_slice = keyed.filter(patient.isNotNull()).groupBy(*cell).agg(
            *[_AGGREGATE[m.how](f"_m_{m.name}").alias(f"_s_{m.name}") for m in measures]
        )
        middle = Window.partitionBy(*ENTITY).orderBy("_slice").rangeBetween(-between, -1)
        mids = per_slice.select(
            *cell, *[_AGGREGATE[m.how](f"_s_{m.name}").over(middle).alias(f"_mid_{m.name}") for m in measures]
        )
        ranged = ranged.join(mids, cell, "left")
        sources.append("mid")

    history = F.struct(
        *[_merge(m.how, [F.col(f"_{s}_{m.name}") for s in sources]).alias(m.name) for m in measures]
    )
    return ranged.select(*columns, history.alias("history"))


def with_history_as_of_arrival(
    events: DataFrame, window_ms: int, measures: list[Measure] | None = None, partitions: int | None = None
) -> DataFrame:
    """Like ``with_history``, but a window holds only what had arrived when its event did.

    An event at time t sees the events of its patient and type in [t - w, t] that come no later in the order of
    (arrival, event id), itself included, as a service does that looks into its store while events come in any order
    of time. Events without an arrival come first. Expects one row per event id.

    Both conditions together are a dominance sum, which no window frame expresses. Slices are as wide as the window,
    so a window is the head of its own slice and the tail of the one before. Inside a slice, rows are
    numbered by arrival, and the numbers are halved again and again: at each level, a row in the left
    half of a node adds to the rows in the right half, where arrival is settled and a running frame over time is left. Two rows meet
    at exactly one level. A slice of n rows costs n log n narrow rows, spread over its nodes; no list of a window is built.

    ``partitions`` deals the slices to so many tasks. Left out, adaptive execution sets tasks by the few bytes of the rows before
    they are multiplied by their levels, so that a task's memory grows with the table.
    """
    measures = measures or vital_and_bed_measures()
    patient = first_non_blank(F.col("patient_id"))
    own_value = {f"_m_{m.name}": m.value for m in measures}
    at = F.unix_millis("event_time")
    slice_of = F.floor(at / F.lit(window_ms))
    lone = patient.isNull()
    narrow = events.filter(~lone).select(
        patient.alias("history_key"),
        "event_type",
        "event_id",
        F.coalesce(F.unix_micros("arrival_time"), F.lit(-(2**62))).alias("_came"),
        at.alias("_at"),
        slice_of.alias("_slice"),
        *[value.alias(name) for name, value in own_value.items()],
    )
    sent = narrow.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumns(
        {
            "_slice": F.when(F.col("_own"), F.col("_slice")).otherwise(F.col("_slice") + 1),
            "_pos": F.when(F.col("_own"), F.col("_at")).otherwise(F.col("_at") + window_ms),
        }
    )
    if partitions:
        sent = sent.repartition(partitions, *ENTITY, "_slice")
    cell = Window.partitionBy(*ENTITY, "_slice")
    numbered = sent.withColumns(
        {
            "_rank": (F.row_number().over(cell.orderBy("_came", "event_id")) - 1).cast("bigint"),
            "_rows": F.count("*").over(cell),
        }
    )
    # Right half: the row asks; left half: it gives, if anything is in the right half. A tail never asks.
    levels = F.expr(
        """filter(sequence(0, length(bin(_rows - 1)) - 1), l -> if(
          (shiftright(_rank, l) & 1) = 1, _own, shiftleft(shiftright(_rank, l) + 1, l) < _rows))"""
    )
    spread = numbered.withColumn("_level", F.explode(levels)).withColumns(
        {
            "_asks": F.expr("(shiftright(_rank, _level) & 1) = 1"),
            "_node": F.expr("shiftright(_rank, _level + 1)"),
        }
    )
    node = Window.partitionBy(*ENTITY, "_slice", "_level", "_node")
    forward = node.orderBy(F.col("_pos")).rangeBetween(Window.unboundedPreceding, 0)
    backward = node.orderBy(F.col("_pos").desc()).rangeBetween(Window.unboundedPreceding, 0)
    gives, own = ~F.col("_asks"), F.col("_own")
    parts = {}
    for m in measures:
        value, how = F.col(f"_m_{m.name}"), _AGGREGATE[m.how]
        parts[f"_head_{m.name}"] = how(F.when(gives & own, value)).over(forward)
        parts[f"_tail_{m.name}"] = how(F.when(gives & ~own, value)).over(backward)
    answers = spread.withColumns(parts).filter("_asks")
    found = answers.groupBy("event_id").agg(
        *[
            _AGGREGATE[m.how](_merge(m.how, [F.col(f"_head_{m.name}"), F.col(f"_tail_{m.name}")])).alias(f"_f_{m.name}")
            for m in measures
        ]
    )
    history = F.struct(
        *[_merge(m.how, [F.col(f"_m_{m.name}"), F.col(f"_f_{m.name}")]).alias(m.name) for m in measures]
    )
    return events.withColumns(own_value).join(found, "event_id", "left").select(*events.columns, history.alias("history"))


def hr_mean() -> Column:
    return _HR_CENTRE + F.col("history.hr_offset") / F.col("history.hr_n")


def hr_variance() -> Column:
    """Population variance: 0 for one value, null for none."""
    n, offset = F.col("history.hr_n"), F.col("history.hr_offset")
    spread = F.col("history.hr_square") / n - (offset / n) * (offset / n)
    return F.when(n == 1, F.lit(0.0)).when(n > 1, F.greatest(F.lit(0.0), spread))


def hr_slope() -> Column:
    """(last - first) / (n - 1) over the heart rates of the window; null below two values."""
    rise = F.col("history.hr_last.value") - F.col("history.hr_first.value")
    return F.when(F.col("history.hr_n") > 1, rise / (F.col("history.hr_n") - 1))
