"""Feature vectors: one wide struct per event, columns filled by event type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import built_once, seconds_between
from tributary.operators.history import hr_mean, hr_slope, hr_variance, with_history, with_history_as_of_arrival
from tributary.settings import DEFAULTS, Settings

# Codes and defaults of the imaging features, and the fewest vitals of a full window.
ACUITY = {"low": 1, "medium": 2, "high": 3}
MODALITY = {"XRAY": 1, "US": 2, "CT": 3, "MRI": 4, "PET": 5}
DEFAULT_CODE = 2
MIN_OBSERVATIONS = 3


def _lookup(col: Column, codes: dict[str, int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), F.lit(default))


def _null_count(*cols: Column) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + c.isNull().cast("int")
    return total


def vital_features() -> dict[str, Column]:
    vital, history = F.col("attributes.patient_vital"), F.col("history")
    hr, spo2, rr = vital["heart_rate"], vital["spo2"], vital["respiratory_rate"]
    return {
        "heart_rate": hr,
        "spo2": spo2,
        "respiratory_rate": rr,
        "temperature_c": vital["temperature_c"],
        "systolic_bp": vital["systolic_bp"],
        "diastolic_bp": vital["diastolic_bp"],
        "heart_rate_mean_5m": F.when(history["hr_n"] > 0, hr_mean()),
        "heart_rate_min_5m": history["hr_min"],
        "heart_rate_max_5m": history["hr_max"],
        "hr_variance_5m": hr_variance(),
        "hr_slope_5m": hr_slope(),
        "spo2_mean_5m": F.when(history["spo2_n"] > 0, history["spo2_sum"] / history["spo2_n"]),
        "spo2_min_5m": history["spo2_min"],
        "spo2_delta_5m": spo2 - history["spo2_first"]["value"],
        "rr_mean_5m": F.when(history["rr_n"] > 0, history["rr_sum"] / history["rr_n"]),
        "observation_count": history["events"],
        "missing_ratio": _null_count(hr, spo2, rr) / F.lit(3.0),
    }


def bed_features() -> dict[str, Column]:
    bed, history = F.col("attributes.bed_status"), F.col("history")
    return {
        "occupancy_ratio": bed["occupancy_ratio"],
        "occupied_count": history["occupied"],
        "available_count": history["available"],
        "occupancy_mean": F.when(history["ratio_n"] > 0, history["ratio_sum"] / history["ratio_n"]),
        "missing_ratio": bed["occupancy_ratio"].isNull().cast("double"),
    }


def imaging_features() -> dict[str, Column]:
    imaging = F.col("attributes.imaging_request")
    hint = F.coalesce(F.nullif(imaging["acuity_hint"], F.lit("")), F.lit("medium"))
    return {
        "waiting_minutes": F.coalesce(imaging["waiting_minutes"], F.lit(0).cast("bigint")),
        "acuity_code": _lookup(hint, ACUITY, DEFAULT_CODE),
        "modality_code": _lookup(imaging["modality"], MODALITY, DEFAULT_CODE),
        "missing_ratio": F.lit(0.0),
    }


def lab_features() -> dict[str, Column]:
    lab = F.col("attributes.lab_result")
    return {
        "lab_value": lab["value"],
        "abnormal_flag": F.coalesce(lab["abnormal_flag"], F.lit(False)).cast("int"),
        "missing_ratio": F.lit(0.0),
    }


def resource_features() -> dict[str, Column]:
    """A capacity of 0 counts as 1, so the occupied count can be negative."""
    resource = F.col("attributes.resource_update")
    available = F.coalesce(resource["available"], F.lit(0).cast("bigint"))
    capacity = F.coalesce(F.nullif(resource["capacity"], F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))
    return {
        "occupancy_ratio": F.lit(1.0) - available / capacity,
        "occupied_count": capacity - available,
        "available_count": available,
        "missing_ratio": F.lit(0.0),
    }


def default_features() -> dict[str, Column]:
    return {"missing_ratio": F.lit(0.0)}


FEATURES_BY_TYPE = {
    "patient_vital": vital_features,
    "bed_status": bed_features,
    "imaging_request": imaging_features,
    "lab_result": lab_features,
    "resource_update": resource_features,
    "device_reading": default_features,
    "appointment_event": default_features,
}


@built_once
def _wide_features() -> Column:
    """Every feature name once; each column dispatches on the event type."""
    by_name: dict[str, Column] = {}
    for event_type, build in FEATURES_BY_TYPE.items():
        mine = F.col("event_type") == event_type
        for name, value in build().items():
            by_name[name] = by_name[name].when(mine, value) if name in by_name else F.when(mine, value)
    return F.struct(*[value.alias(name) for name, value in by_name.items()])


def feature_vectors(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Events with ``features``, ``window_sizes``, ``stale`` and ``insufficient_observations``."""
    if settings.as_of_arrival:
        with_window = with_history_as_of_arrival(events, settings.window_ms)
    else:
        with_window = with_history(events, settings.window_ms, settings.slice_ms)
    late_s = seconds_between(F.col("arrival_time"), F.col("event_time"))
    return with_window.withColumns(
        {
            "features": _wide_features(),
            "window_sizes": F.create_map(F.lit("5m"), F.col("history.events")),
            "stale": late_s > settings.lateness_s,
            "insufficient_observations": (F.col("event_type") == "patient_vital")
            & (F.col("history.events") < MIN_OBSERVATIONS),
        }
    ).drop("history")


def latest_features(vectors: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Last written vector per patient as a reader at ``as_of`` sees it: gone after the time to live.

    The age limit is a filter on arrival time, so it reaches the scan; the latest row per patient is
    chosen before the shuffle (partial group limit).
    """
    from tributary.operators.dedup import keep_first

    live = vectors.filter(
        (F.col("arrival_time") <= as_of)
        & (F.col("arrival_time") > as_of - F.expr(f"interval {settings.feature_ttl_s} seconds"))
        & (F.coalesce(F.col("patient_id"), F.lit("")) != "")
    )
    return keep_first(live, ["patient_id"], [F.col("arrival_time").desc(), F.col("event_id").desc()])
