"""The registered queries: one per operator, each over the whole tables, with its DuckDB counterpart.

Times leave as microseconds and arrays as joined text, so both engines return plain columns. Sums
whose order is free are shown with six digits (``near``), row-local results as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.functions.columns import partition_key, seconds_between
from tributary.operators import alerts as A
from tributary.operators import decisions as D
from tributary.operators import forest as IF
from tributary.operators import metrics as M
from tributary.operators import models as MD
from tributary.operators import reports as R
from tributary.operators import risk as K
from tributary.operators import scoring as S
from tributary.operators.dedup import dedup_events, duplicate_report, replay_quarantine, upsert_dimension
from tributary.operators.features import feature_vectors, latest_features
from tributary.operators.history import hr_mean, hr_slope, hr_variance, with_history, with_history_as_of_arrival
from tributary.operators.registry import model_hash, route_models
from tributary.operators.validate import canonicalize, parse_wire, quarantine_rows, typed_payload
from tributary.plans import flow
from tributary.plans.oracle import breaker_steps, near, round_even, sql
from tributary.schema import PAYLOADS, STAGES
from tributary.session import shared_folder, shuffled_by, use_engine_settings
from tributary.sources.streams import read_raw_events, stage_messages, write_stage
from tributary.sources.tables import patients, spread_partitions, table, wire_events
from tributary.streaming.kpis import open_alerts_by_severity, run_model_stats, run_open_alerts, stored_model_stats
from tributary.streaming.replay import REPLAYS, marked_quarantine, replayed_messages, run_replays
from tributary.streaming.snapshot import run_latest_features, stored_latest_features
from tributary.streaming.stages import alert_states, kpis, run_alert_lifecycle, run_events, run_kpis, run_quarantine

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def wrap(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_engine_settings(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return query

    return wrap


def us(col: str | Column) -> Column:
    return F.unix_micros(col)


def six(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + 1e-9, 6)


def joined(col: str | Column) -> Column:
    return F.array_join(col, ",")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _extended(select: str, extra: str, *steps: str) -> str:
    """A query with its own steps after the shared ones."""
    return sql("SELECT 1", *steps).removesuffix("\nSELECT 1") + ",\n" + extra + "\n" + select


# --- sources and reference data ---------------------------------------------------------------


@register(
    "read_raw_events",
    sql(
        """SELECT event_id, source_id, event_type, patient_id, device_id, resource_id, schema_version, trace_id, arrival_us
FROM wire""",
        "wire",
    ),
)
def read_raw_events_query(spark, sf):
    parsed = parse_wire(wire_events(spark, sf))
    names = ["event_id", "source_id", "event_type", "patient_id", "device_id", "resource_id", "schema_version", "trace_id"]
    return parsed.select(*names, us("arrival_time").alias("arrival_us"))


@register(
    "raw_event_files",
    sql(
        """SELECT event_id, source_id, event_type, patient_id, device_id, resource_id, schema_version, trace_id, true AS dated
FROM wire""",
        "wire",
    ),
)
def raw_event_files_query(spark, sf):
    """Messages written as JSON lines and read again; without an own clock a line came when its file did."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-lines"
    wire_events(spark, sf).select("value").write.text(folder)
    parsed = parse_wire(read_raw_events(spark, folder))
    names = ["event_id", "source_id", "event_type", "patient_id", "device_id", "resource_id", "schema_version", "trace_id"]
    return parsed.select(*names, F.col("arrival_time").isNotNull().alias("dated"))


@register(
    "stage_files",
    sql(
        """SELECT event_id, source_id, arrival_us, strftime(make_timestamp(arrival_us), '%Y-%m-%d') AS arrival_date FROM accepted
WHERE make_timestamp(arrival_us) >= TIMESTAMP '2024-01-10' AND make_timestamp(arrival_us) < TIMESTAMP '2024-01-15'""",
        "accepted",
    ),
)
def stage_files_query(spark, sf):
    """The accepted stage written by arrival date; five days of it are read, the others are not opened."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-stages"
    write_stage(flow.accepted(spark, sf), folder, "validated")
    days = spark.read.parquet(f"{folder}/validated").filter(F.col("arrival_date").between(F.lit("2024-01-10"), F.lit("2024-01-14")))
    return days.select(
        "event_id", "source_id", us("arrival_time").alias("arrival_us"), F.col("arrival_date").cast("string").alias("arrival_date")
    )


@register(
    "write_stage",
    sql(
        f"""SELECT '{STAGES["validated"]}' AS topic, coalesce(patient_id, resource_id, source_id) AS key, event_id,
  schema_version::BIGINT AS schema_version FROM accepted""",
        "accepted",
    ),
)
def write_stage_query(spark, sf):
    messages = stage_messages(flow.accepted(spark, sf).drop("attributes", "value"), "validated")
    return messages.select(
        "topic",
        "key",
        F.get_json_object("value", "$.event_id").alias("event_id"),
        F.get_json_object("value", "$.schema_version").cast("bigint").alias("schema_version"),
    )


@register(
    "write_quarantine",
    sql(
        f"""SELECT '{STAGES["raw"]}' AS original_topic, event_id, code AS failure_code, error, false AS replayed,
  arrival_us AS created_us FROM checked WHERE code IS NOT NULL""",
        "checked",
    ),
)
def write_quarantine_query(spark, sf):
    return quarantine_rows(flow.checked(spark, sf)).select(
        "original_topic", "event_id", "failure_code", "error", "replayed", us("created_at").alias("created_us")
    )


@register(
    "upsert_dimension",
    sql(
        """SELECT external_ref, display_name, ward_id FROM patients
UNION ALL SELECT 'pat_' || p_partkey, p_name, 'ward_' || (p_partkey % 12) FROM part
WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""",
        "patients",
    ),
)
def upsert_dimension_query(spark, sf):
    key = F.col("p_partkey").cast("string")
    new = table(spark, sf, "part").select(
        F.concat(F.lit("pat_"), key).alias("external_ref"),
        F.col("p_name").alias("display_name"),
        F.concat(F.lit("ward_"), (F.col("p_partkey") % 12).cast("string")).alias("ward_id"),
    )
    return upsert_dimension(patients(spark, sf), new, "external_ref")


@register(
    "partition_key",
    sql("SELECT event_id, coalesce(patient_id, resource_id, source_id, event_id) AS key FROM accepted", "accepted"),
)
def partition_key_query(spark, sf):
    return flow.accepted(spark, sf).select("event_id", partition_key().alias("key"))


# --- parse, validate, dedup -------------------------------------------------------------------


def _failures(spark, sf, pattern: str) -> DataFrame:
    return (
        flow.checked(spark, sf)
        .filter(F.col("failure.error").rlike(pattern))
        .select("wire_event_id", us("arrival_time").alias("arrival_us"), F.col("failure.*"))
        .withColumnRenamed("wire_event_id", "event_id")
    )


def _failure_sql(condition: str) -> str:
    return sql(f"SELECT event_id, arrival_us, code, error FROM checked WHERE {condition}", "checked")


register(
    "validate_envelope",
    sql(
        "SELECT event_id, arrival_us, coalesce(error NOT LIKE 'invalid event%', true) AS envelope_ok FROM checked",
        "checked",
    ),
)(
    lambda spark, sf: flow.checked(spark, sf).select(
        F.col("wire_event_id").alias("event_id"),
        us("arrival_time").alias("arrival_us"),
        F.coalesce(~F.col("failure.error").startswith("invalid event"), F.lit(True)).alias("envelope_ok"),
    )
)
register("validate_timestamp", _failure_sql("error LIKE '%timestamp%'"))(
    lambda spark, sf: _failures(spark, sf, "timestamp ")
)
register("validate_required_ids", _failure_sql("error LIKE '% requires %'"))(
    lambda spark, sf: _failures(spark, sf, " requires ")
)
register("validate_payload", _failure_sql("error LIKE 'invalid payload%'"))(
    lambda spark, sf: _failures(spark, sf, "^invalid payload")
)
register("failure_code", sql("SELECT event_id, arrival_us, code FROM checked", "checked"))(
    lambda spark, sf: flow.checked(spark, sf).select(
        F.col("wire_event_id").alias("event_id"),
        us("arrival_time").alias("arrival_us"),
        F.col("failure.code").alias("code"),
    )
)


@register(
    "split_valid_quarantine",
    sql(
        """SELECT CASE WHEN code IS NULL THEN 'valid' ELSE 'quarantine' END AS side, event_type, count(*) AS n
FROM checked GROUP BY 1, 2""",
        "checked",
    ),
)
def split_query(spark, sf):
    side = F.when(F.col("failure").isNull(), "valid").otherwise("quarantine").alias("side")
    return flow.checked(spark, sf).groupBy(side, "event_type").agg(F.count("*").alias("n"))


@register(
    "canonicalize",
    sql(
        """SELECT event_id, patient_id, device_id, resource_id, event_type, event_us, source_id AS source, schema_version,
  trace_id, CASE WHEN event_type = 'device_reading'
    THEN coalesce(CASE k % 4 WHEN 1 THEN 'poor' WHEN 2 THEN 'unknown' END, 'good') END AS quality,
  CASE WHEN event_type = 'lab_result' THEN abnormal END AS abnormal_flag,
  CASE WHEN event_type = 'appointment_event' THEN CASE WHEN n % 4 = 0 THEN 0 ELSE k END::BIGINT END AS wait_minutes
FROM accepted""",
        "accepted",
    ),
)
def canonicalize_query(spark, sf):
    return canonicalize(flow.accepted(spark, sf)).select(
        "event_id",
        "patient_id",
        "device_id",
        "resource_id",
        "event_type",
        us("event_time").alias("event_us"),
        "source",
        "schema_version",
        "trace_id",
        F.col("attributes.device_reading.quality").alias("quality"),
        F.col("attributes.lab_result.abnormal_flag").alias("abnormal_flag"),
        F.col("attributes.appointment_event.wait_minutes").alias("wait_minutes"),
    )


TYPED_SQL = {
    "patient_vital": """hr AS heart_rate, spo2, rr AS respiratory_rate, temp AS temperature_c, sbp AS systolic_bp,
  dbp AS diastolic_bp""",
    "device_reading": """'spo2_probe' AS metric, value, CASE WHEN n % 3 <> 0 THEN 'pct' END AS unit,
  CASE k % 4 WHEN 1 THEN 'poor' WHEN 2 THEN 'unknown' ELSE 'good' END AS quality""",
    "bed_status": """'ward_' || (n % 12) AS ward_id, 'bed_' || (n % 40) AS bed_id, bed AS status,
  ratio AS occupancy_ratio""",
    "imaging_request": """modality, ['chest', 'head', 'knee'][n % 3 + 1] AS body_part, waiting AS waiting_minutes,
  acuity AS acuity_hint""",
    "lab_result": "'lab_' || (n % 9) AS test_code, value, 'mg' AS unit, abnormal AS abnormal_flag",
    "resource_update": """['staff', 'room', 'equipment'][n % 3 + 1] AS resource_type, 'res_' || (n % 12) AS resource_id,
  available, capacity""",
    "appointment_event": """'apt_' || n AS appointment_id,
  ['scheduled', 'arrived', 'in_progress', 'completed', 'no_show'][k % 5 + 1] AS status, 'dep_' || (n % 6) AS department,
  CASE WHEN n % 4 = 0 THEN 0 ELSE k END::BIGINT AS wait_minutes""",
}
for _type in PAYLOADS:
    register(
        f"typed_payload_{_type}",
        sql(f"SELECT event_id, {TYPED_SQL[_type]} FROM accepted WHERE event_type = '{_type}'", "accepted"),
    )(lambda spark, sf, _type=_type: typed_payload(flow.accepted(spark, sf), _type))


register("dedup_events", sql("SELECT event_id, source_id, arrival_us FROM accepted", "accepted"))(
    lambda spark, sf: dedup_events(flow.valid(spark, sf)).select(
        "event_id", "source_id", us("arrival_time").alias("arrival_us")
    )
)
register(
    "duplicate_report",
    sql(
        """SELECT event_id, count(*) - 1 AS suppressed, count(DISTINCT source_id) AS sources
FROM checked WHERE code IS NULL GROUP BY 1 HAVING count(*) > 1""",
        "checked",
    ),
)(lambda spark, sf: duplicate_report(flow.valid(spark, sf)))


def _replay(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replays every message refused for its clock, an hour after it came."""
    held = flow.quarantine(spark, sf)
    chosen = held.filter(F.col("failure_code") == "CLOCK_SKEW")
    return replay_quarantine(
        held, chosen, flow.accepted(spark, sf), F.timestamp_micros(us("created_at") + 3_600_000_000)
    )


_REPLAYED = """SELECT * FROM checked WHERE code = 'CLOCK_SKEW'"""
_REPLAY_OK = """NOT (event_type IN ('patient_vital', 'device_reading', 'lab_result') AND patient_id IS NULL)
  AND NOT (event_type = 'device_reading' AND device_id IS NULL) AND NOT (event_type = 'patient_vital' AND coalesce(hr, 0) > 300)
  AND n % 61 <> 0 AND coalesce(length(patient_id), 0) <= 100"""


register(
    "replay_quarantine",
    sql(
        f"""SELECT event_id, source_id, arrival_us + 3600000000 AS arrival_us FROM checked
WHERE code = 'CLOCK_SKEW' AND {_REPLAY_OK} AND event_id NOT IN (SELECT event_id FROM accepted)
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_us) = 1""",
        "accepted",
    ),
)(lambda spark, sf: _replay(spark, sf)[0].select("event_id", "source_id", us("arrival_time").alias("arrival_us")))
register(
    "replay_marks",
    sql(
        """SELECT event_id, code AS failure_code, arrival_us AS created_us, code = 'CLOCK_SKEW' AS replayed
FROM checked WHERE code IS NOT NULL""",
        "checked",
    ),
)(
    lambda spark, sf: _replay(spark, sf)[2].select(
        "event_id", "failure_code", us("created_at").alias("created_us"), "replayed"
    )
)
register(
    "validation_audit",
    sql(
        """SELECT trace_id, 'ingestion' AS actor, 'EVENT_VALIDATED' AS action, 'event' AS resource_type,
  event_id AS resource_id, arrival_us AS created_us FROM accepted""",
        "accepted",
    ),
)(
    lambda spark, sf: A.validation_audit(flow.accepted(spark, sf)).select(
        "trace_id", "actor", "action", "resource_type", "resource_id", us("created_at").alias("created_us")
    )
)


# --- features ---------------------------------------------------------------------------------


@register("history_window", sql("SELECT event_id, events FROM hist", "hist"))
def history_window_query(spark, sf):
    history = with_history(flow.accepted(spark, sf), flow.WIDE.window_ms)
    return history.select("event_id", F.col("history.events").alias("events"))


@register(
    "history_as_of_arrival",
    sql(
        f"""SELECT event_id, events, {near('hr_mean')} AS hr_mean, hr_min, hr_max, {near('hr_var')} AS hr_var,
  {near('(hr_last - hr_first) / nullif(hr_n - 1, 0)')} AS hr_slope, spo2_min FROM hist_arrived""",
        "hist_arrived",
    ),
)
def history_as_of_arrival_query(spark, sf):
    """Arrivals are put off by up to 59 hours: windows hold only what had come by then."""
    hours = flow.event_number(F.col("event_id")) * 7 % 60
    put_off = flow.accepted(spark, sf).withColumn(
        "arrival_time", F.timestamp_micros(us("arrival_time") + hours * 3_600_000_000)
    )
    tasks = spread_partitions(table(spark, sf, "events"))
    return with_history_as_of_arrival(put_off, flow.WIDE.window_ms, partitions=tasks).select(
        "event_id",
        F.col("history.events").alias("events"),
        F.when(F.col("history.hr_n") > 0, six(hr_mean())).alias("hr_mean"),
        F.col("history.hr_min").alias("hr_min"),
        F.col("history.hr_max").alias("hr_max"),
        six(hr_variance()).alias("hr_var"),
        six(hr_slope()).alias("hr_slope"),
        F.col("history.spo2_min").alias("spo2_min"),
    )


VITALS_RAW = ["heart_rate", "spo2", "respiratory_rate", "temperature_c", "systolic_bp", "diastolic_bp"]
VITALS_EXACT = ["heart_rate_min_5m", "heart_rate_max_5m", "spo2_min_5m", "observation_count"]
VITALS_NEAR = ["heart_rate_mean_5m", "hr_variance_5m", "hr_slope_5m", "spo2_mean_5m", "spo2_delta_5m", "rr_mean_5m"]


def _features(name: str, exact: list[str], close: list[str], kind: str | None, key: str = "event_id") -> None:
    """Register a query that shows some feature columns of one event type (or of all)."""
    shown = [key, *exact, *[f"{near(c)} AS {c}" for c in close]]
    where = f" WHERE event_type = '{kind}'" if kind else ""

    def query(spark, sf):
        rows = feature_vectors(flow.accepted(spark, sf), flow.WIDE)
        rows = rows.filter(F.col("event_type") == kind) if kind else rows
        return rows.select(
            key, *[F.col(f"features.{c}") for c in exact], *[six(f"features.{c}").alias(c) for c in close]
        )

    register(name, sql(f"SELECT {', '.join(shown)} FROM feat{where}", "feat"))(query)


VITAL, BED = "patient_vital", "bed_status"
_features("vital_mean", [], ["heart_rate_mean_5m", "spo2_mean_5m", "rr_mean_5m"], VITAL)
_features("vital_min_max", ["heart_rate_min_5m", "heart_rate_max_5m", "spo2_min_5m"], [], VITAL)
_features("hr_variance", [], ["hr_variance_5m"], VITAL)
_features("hr_slope", [], ["hr_slope_5m"], VITAL)
_features("spo2_delta", [], ["spo2_delta_5m"], VITAL)
_features("observation_count", ["observation_count"], [], VITAL)
_features("vital_missing_ratio", [], ["missing_ratio"], VITAL)
_features("vital_features", VITALS_RAW + VITALS_EXACT, VITALS_NEAR + ["missing_ratio"], VITAL)
_features("bed_features", ["occupied_count", "available_count"], ["occupancy_ratio", "occupancy_mean", "missing_ratio"], BED)
_features("imaging_features", ["waiting_minutes", "acuity_code", "modality_code", "missing_ratio"], [], "imaging_request")
_features("lab_features", ["lab_value", "abnormal_flag", "missing_ratio"], [], "lab_result")
_features("resource_features", ["occupied_count", "available_count", "missing_ratio"], ["occupancy_ratio"], "resource_update")
_features("default_features_device", ["missing_ratio"], [], "device_reading")
_features("default_features_appointment", ["missing_ratio"], [], "appointment_event")

register("stale_flag", sql("SELECT event_id, stale FROM feat", "feat"))(
    lambda spark, sf: flow.vectors(spark, sf).select("event_id", "stale")
)
register("insufficient_flag", sql("SELECT event_id, insufficient FROM feat", "feat"))(
    lambda spark, sf: flow.vectors(spark, sf).select(
        "event_id", F.col("insufficient_observations").alias("insufficient")
    )
)

ALL_EXACT = VITALS_RAW + VITALS_EXACT + [
    "occupied_count",
    "available_count",
    "waiting_minutes",
    "acuity_code",
    "modality_code",
    "lab_value",
    "abnormal_flag",
]
ALL_NEAR = VITALS_NEAR + ["missing_ratio", "occupancy_ratio", "occupancy_mean"]


@register(
    "feature_vector",
    sql(
        f"""SELECT event_id, event_type, patient_id, trace_id, {', '.join(ALL_EXACT)},
{', '.join(f'{near(c)} AS {c}' for c in ALL_NEAR)}, events AS window_5m, stale, insufficient FROM feat""",
        "feat",
    ),
)
def feature_vector_query(spark, sf):
    return _vector_columns(feature_vectors(flow.accepted(spark, sf), flow.WIDE))


def _vector_columns(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        "event_id",
        "event_type",
        "patient_id",
        "trace_id",
        *[F.col(f"features.{c}") for c in ALL_EXACT],
        *[six(f"features.{c}").alias(c) for c in ALL_NEAR],
        F.col("window_sizes")["5m"].alias("window_5m"),
        "stale",
        F.col("insufficient_observations").alias("insufficient"),
    )


AS_OF = "2024-01-20 06:00:00"
AS_OF_US = f"epoch_us(TIMESTAMP '{AS_OF}')"


@register(
    "latest_features",
    sql(
        f"""SELECT patient_id, event_id, event_type, arrival_us FROM feat
WHERE patient_id IS NOT NULL AND arrival_us <= {AS_OF_US} AND arrival_us > {AS_OF_US} - 172800000000
QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY arrival_us DESC, event_id DESC) = 1""",
        "feat",
    ),
)
def latest_features_query(spark, sf):
    lasting = replace(flow.WIDE, feature_ttl_s=172_800)
    latest = latest_features(flow.vectors(spark, sf), at(AS_OF), lasting)
    return latest.select("patient_id", "event_id", "event_type", us("arrival_time").alias("arrival_us"))


# --- models -----------------------------------------------------------------------------------

register(
    "route_models",
    sql("SELECT event_id, position, model_name, model_version FROM routed", "routed"),
)(
    lambda spark, sf: flow.accepted(spark, sf).select("event_id", F.inline(route_models(F.col("event_type"))))
)


@register(
    "numeric_default",
    sql(
        """SELECT event_id, coalesce(heart_rate, 80.0::DOUBLE) AS heart_rate, coalesce(spo2, 98.0::DOUBLE) AS spo2,
  coalesce(respiratory_rate, 16.0::DOUBLE) AS respiratory_rate, coalesce(temperature_c, 36.8::DOUBLE) AS temperature_c,
  coalesce(systolic_bp, 120.0::DOUBLE) AS systolic_bp FROM feat""",
        "feat",
    ),
)
def numeric_default_query(spark, sf):
    names = [name for name, default in S.RISK_INPUTS if default is not None]
    inputs = S.model_inputs(S.RISK_INPUTS)
    return flow.vectors(spark, sf).select("event_id", *[c.alias(n) for c, n in zip(inputs, names)])


def _scorer(name: str, build: Callable[[], Column], oracle: str, kinds: tuple[str, ...]) -> None:
    listed = ", ".join(f"'{k}'" for k in kinds)

    def query(spark, sf):
        rows = flow.with_fixed_raw(flow.vectors(spark, sf)).filter(F.col("event_type").isin(*kinds))
        scored = rows.select("event_id", build().alias("s"))
        return scored.select("event_id", six("s.score").alias("score"), "s.label", six("s.confidence").alias("confidence"))

    register(name, sql(f"SELECT event_id, {oracle} WHERE event_type IN ({listed})", "scores"))(query)


_scorer(
    "score_threshold",
    S.score_threshold,
    f"""{near('threshold')} AS score, CASE WHEN hits > 0 THEN 'anomalous' ELSE 'nominal' END AS label,
  {near("CASE WHEN hits > 0 THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END")} AS confidence FROM scores""",
    ("patient_vital",),
)
_scorer(
    "score_capacity",
    S.score_capacity,
    f"""{near('capacity_score')} AS score, CASE WHEN capacity_score >= 0.85 THEN 'congestion' ELSE 'stable' END AS label,
  {near("0.8::DOUBLE")} AS confidence FROM scores""",
    ("bed_status", "resource_update"),
)
_scorer(
    "score_imaging",
    S.score_imaging,
    f"""{near('imaging')} AS score, CASE WHEN imaging >= 0.6 THEN 'prioritize' ELSE 'routine' END AS label,
  {near("0.75::DOUBLE")} AS confidence FROM scores""",
    ("imaging_request",),
)
_scorer(
    "score_data_quality",
    S.score_data_quality,
    f"""{near('quality')} AS score, CASE WHEN quality >= 0.4 THEN 'data_quality_issue' ELSE 'quality_ok' END AS label,
  {near("0.9::DOUBLE")} AS confidence FROM scores""",
    ("patient_vital", "device_reading", "bed_status", "lab_result"),
)
_scorer(
    "score_risk",
    lambda: S.score_risk(flow.FIXED_RISK),
    f"""{near('risk')} AS score, CASE WHEN risk >= 0.55 THEN 'elevated_risk' ELSE 'low_risk' END AS label,
  {near('risk_confidence')} AS confidence FROM scores""",
    ("patient_vital", "lab_result"),
)
_scorer(
    "score_decision_function",
    lambda: S.score_isolation_forest(F.col(S.forest_column("anomaly_detector"))),
    f"""{near('anomaly')} AS score, CASE WHEN anomaly >= 0.65 THEN 'anomalous' ELSE 'nominal' END AS label,
  {near('anomaly_confidence')} AS confidence FROM scores""",
    ("patient_vital",),
)


@register("train_isolation_forest")
def train_forest_query(spark, sf):
    rows = flow.vital_vectors(spark, sf)
    return IF.train_isolation_forest(rows, rows.count())


@register("score_isolation_forest")
def score_forest_query(spark, sf):
    """Trains on all vitals, then scores all of them under the primary's and the shadow's offset."""
    rows = flow.vital_vectors(spark, sf)
    forest = IF.fit_forest(rows)
    offsets = IF.forest_offsets(rows, forest, IF.CONTAMINATION)
    raw = IF.with_forest_raw(rows, forest, offsets)
    shown = {name: S.score_isolation_forest(F.col(S.forest_column(name))) for name in offsets}
    return raw.select(
        "event_id",
        shown["anomaly_detector"]["score"].alias("score"),
        shown["anomaly_detector"]["label"].alias("label"),
        shown["anomaly_detector_shadow"]["score"].alias("shadow_score"),
    )


@register("train_risk_model")
def train_risk_query(spark, sf):
    model = K.train_risk_model(flow.vital_vectors(spark, sf))
    rows = [("intercept", model.intercept)]
    rows += [(name, w) for (name, _), w in zip(S.RISK_INPUTS, model.weights)]
    return spark.createDataFrame(rows, "input string, weight double")


_VITALS = "SELECT count(*) AS rows FROM feat WHERE event_type = 'patient_vital'"


@register(
    "forest_tree_rows",
    sql(
        f"""SELECT t.i::INT AS tree, least(256, v.rows)::BIGINT AS root_rows, least(256, v.rows)::BIGINT AS leaf_rows, true AS whole
FROM range(60) t(i), ({_VITALS}) v""",
        "feat",
    ),
)
def forest_tree_rows_query(spark, sf):
    """Each tree has its whole sample, every split shares out its rows, and the leaves hold them all."""
    rows = flow.vital_vectors(spark, sf)
    return IF.tree_rows(IF.train_isolation_forest(rows, rows.count()))


@register(
    "forest_offset_shares",
    sql(
        f"""SELECT m.name AS model_name, v.rows, floor(m.share * (v.rows - 1))::BIGINT AS position, true AS holds
FROM ({_VITALS}) v, (VALUES ('anomaly_detector', 0.03::DOUBLE), ('anomaly_detector_shadow', 0.08::DOUBLE)) m(name, share)""",
        "feat",
    ),
)
def forest_offset_shares_query(spark, sf):
    """A stored offset stands at its share of the training rows: no more are below it, no fewer at it or below."""
    release = MD.releases(spark, flow.model_folder(spark, sf))[-1]
    shares = IF.offset_shares(flow.vital_vectors(spark, sf), release.forest, release.offsets)
    share = F.element_at(F.create_map(*[F.lit(x) for pair in IF.CONTAMINATION.items() for x in pair]), F.col("model_name"))
    position = F.floor(share * (F.col("rows") - 1))
    return shares.select(
        "model_name",
        "rows",
        position.alias("position"),
        ((F.col("below") <= position + 1) & (F.col("at_or_below") > position)).alias("holds"),
    )


@register(
    "risk_gradient",
    sql(
        """SELECT i.input, count(*) AS rows, count(*) FILTER (WHERE coalesce(heart_rate, 80) > 115 OR coalesce(spo2, 98) < 93
    OR coalesce(respiratory_rate, 16) > 25) AS positives, true AS vanishes
FROM feat, (VALUES ('intercept'), ('heart_rate'), ('spo2'), ('respiratory_rate'), ('temperature_c'), ('systolic_bp'),
  ('heart_rate_mean_15m')) i(input) WHERE event_type = 'patient_vital' GROUP BY 1""",
        "feat",
    ),
)
def risk_gradient_query(spark, sf):
    """The stored coefficients are the minimum of the penalised loss over all rows: its gradient vanishes there."""
    release = MD.releases(spark, flow.model_folder(spark, sf))[-1]
    gradient = MD.risk_gradient(flow.vital_vectors(spark, sf), release.risk)
    vanishes = F.abs("gradient") <= F.lit(1e-4) * F.col("size")
    return gradient.select("input", "rows", "positives", vanishes.alias("vanishes"))


_RELEASES_SQL = """releases AS (
  SELECT r.release, r.valid_us, m.name AS model_name, m.version || r.suffix AS model_version
  FROM (VALUES (1, epoch_us(TIMESTAMP '2024-01-08'), ''), (2, epoch_us(TIMESTAMP '2024-01-16'), '.r2')) r(release, valid_us, suffix),
    (VALUES ('anomaly_detector', '2.1'), ('anomaly_detector_shadow', '2.2-shadow'), ('risk_predictor', '1.4')) m(name, version))"""


@register(
    "stored_models",
    f"""WITH {_RELEASES_SQL}
SELECT release, valid_us, model_name, model_version, substring(sha256(model_name || ':' || model_version), 1, 16) AS model_hash
FROM releases""",
)
def stored_models_query(spark, sf):
    listed = MD.model_list(MD.stored_models(spark, flow.model_folder(spark, sf)))
    return listed.select("release", us("valid_from").alias("valid_us"), "model_name", "model_version", "model_hash")


@register(
    "trained_predictions",
    _extended(
        """SELECT r.event_id, r.position::INT AS position,
  CASE WHEN l.release IS NULL AND r.model_name = 'anomaly_detector' THEN 'threshold_detector' ELSE r.model_name END AS model_name,
  CASE WHEN l.release IS NULL AND r.model_name = 'anomaly_detector' THEN '1.0' ELSE coalesce(l.model_version, r.model_version) END AS model_version,
  CASE WHEN l.release IS NULL AND r.model_name = 'anomaly_detector' THEN 'fallback'
       WHEN l.release IS NULL AND r.model_name IN ('anomaly_detector_shadow', 'risk_predictor') THEN 'circuit_open'
       WHEN r.model_name LIKE '%_shadow' THEN 'shadow' ELSE 'success' END AS status,
  l.release IS NOT NULL OR r.model_name NOT IN ('anomaly_detector_shadow', 'risk_predictor') AS scored
FROM routed r LEFT JOIN releases l ON l.model_name = r.model_name AND l.valid_us <= r.event_us
QUALIFY row_number() OVER (PARTITION BY r.event_id, r.position ORDER BY l.release DESC NULLS LAST) = 1""",
        _RELEASES_SQL,
        "routed",
    ),
)
def trained_predictions_query(spark, sf):
    """Each event meets the release valid at its time; before the first one, trained models are unreachable."""
    return S.prediction_rows(flow.trained_decisions(spark, sf)).select(
        "event_id",
        "position",
        "model_name",
        "model_version",
        "status",
        F.col("score").isNotNull().alias("scored"),
    )


@register("trained_alerts")
def trained_alerts_query(spark, sf):
    """Alerts of decisions on trained models."""
    alerts = A.open_alerts(flow.trained_decisions(spark, sf))
    return alerts.select("id", "event_id", "severity", "dedup_key", us("created_at").alias("created_us"))


register(
    "shadow_predictions",
    sql(f"SELECT event_id, model_name, status, shadow, {near('score')} AS score FROM preds WHERE shadow", "preds"),
)(
    lambda spark, sf: flow.predictions(spark, sf)
    .filter("shadow")
    .select("event_id", "model_name", "status", "shadow", six("score").alias("score"))
)
register(
    "classify_outcome",
    sql("SELECT event_id, model_name, call_ms AS latency_ms, outcome FROM outcomes", "outcomes"),
)(
    lambda spark, sf: flow.call_log(spark, sf).select(
        "event_id",
        "model_name",
        "latency_ms",
        S.classify_outcome(
            F.col("latency_ms"),
            F.col("failed"),
            F.col("breaker_open"),
            flow_limit(F.col("model_name")),
        ).alias("outcome"),
    )
)


def flow_limit(name: Column) -> Column:
    from tributary.operators.registry import REGISTRY

    return REGISTRY.lookup(name, "timeout_ms")


@register(
    "resolve_fallback",
    sql(
        f"""SELECT event_id, position, model_name, model_version, {near('score')} AS score, label,
  {near('confidence')} AS confidence, latency_ms, status, shadow, fallback_for, primary_status FROM preds""",
        "preds",
    ),
)
def resolve_fallback_query(spark, sf):
    return S.prediction_rows(flow.scored_with_calls(spark, sf)).select(
        "event_id",
        "position",
        "model_name",
        "model_version",
        six("score").alias("score"),
        "label",
        six("confidence").alias("confidence"),
        "latency_ms",
        "status",
        "shadow",
        "fallback_for",
        "primary_status",
    )


BREAKER_AS_OF = "2024-01-28 00:00:00"
BREAKER_US = f"epoch_us(TIMESTAMP '{BREAKER_AS_OF}')"
BREAKER = replace(flow.WIDE, breaker_threshold=1, breaker_reset_s=1800)
_BREAKER_SQL = f"""attempts AS (
  SELECT model_name, status IN ('success', 'shadow', 'fallback') AS ok, arrival_us, event_id FROM preds
    WHERE status <> 'circuit_open'
  UNION ALL SELECT fallback_for, false, arrival_us, event_id FROM preds
    WHERE fallback_for IS NOT NULL AND primary_status <> 'circuit_open'),
numbered AS (
  SELECT *, sum(ok::INT) OVER (PARTITION BY model_name ORDER BY arrival_us DESC, event_id DESC) AS later_ok
  FROM attempts WHERE arrival_us <= {BREAKER_US}),
streaks AS (
  SELECT model_name, count(*) FILTER (WHERE later_ok = 0) AS failures,
    max(arrival_us) FILTER (WHERE later_ok = 0) AS last_failure FROM numbered GROUP BY 1),
breakers AS (
  SELECT model_name, failures, CASE WHEN failures >= 1 THEN last_failure END AS opened_us,
    CASE WHEN failures < 1 THEN 'CLOSED' WHEN last_failure <= {BREAKER_US} - 1800000000 THEN 'HALF_OPEN'
         ELSE 'OPEN' END AS state FROM streaks)"""


def _breakers(spark, sf) -> DataFrame:
    return R.breaker_state(R.call_attempts(flow.predictions(spark, sf)), at(BREAKER_AS_OF), BREAKER)


register("breaker_state", _extended("SELECT * FROM breakers", _BREAKER_SQL, "preds"))(
    lambda spark, sf: _breakers(spark, sf).select("model_name", "failures", us("opened_at").alias("opened_us"), "state")
)


# The replay at one event number a second: routed calls, the primaries' breakers, fallback calls, the fallback's breaker.
_REPLAY_SQL = f"""replay AS (
  SELECT event_id, n, position, model_name, 1706745600000000 + n * 1000000 AS called_us, NULL::VARCHAR AS fallback_for,
    ((n * 7 + position * 31) % 40 + CASE WHEN (n + position) % 29 = 0 THEN 200 ELSE 0 END)::DOUBLE AS latency_ms,
    ((n + position * 37) // 60) % 5 = 0 OR n % 53 = 0 AS failed FROM routed),
timed AS (
  SELECT *, CASE WHEN latency_ms > CASE WHEN model_name LIKE 'anomaly%' THEN 150 WHEN model_name = 'risk_predictor' THEN 200
      WHEN model_name = 'capacity_forecaster' THEN 80 WHEN model_name = 'imaging_prioritizer' THEN 60 ELSE 40 END
    THEN 'timeout' WHEN failed THEN 'error' ELSE 'success' END AS itself FROM replay),
first_calls AS (SELECT *, itself = 'success' AS ok FROM timed),
{breaker_steps("first_calls", "p_")},
second_calls AS (
  SELECT *, itself = 'success' AS ok FROM (
    SELECT event_id, n, position, 'threshold_detector' AS model_name, called_us, model_name AS fallback_for,
      (n % 70)::DOUBLE AS latency_ms, (n // 20) % 3 = 0 AS failed,
      CASE WHEN n % 70 > 50 THEN 'timeout' WHEN (n // 20) % 3 = 0 THEN 'error' ELSE 'success' END AS itself
    FROM p_met WHERE model_name = 'anomaly_detector' AND (NOT ok OR breaker = 'OPEN'))),
{breaker_steps("second_calls", "f_")},
made AS (
  SELECT event_id, position, model_name, fallback_for, called_us, breaker, breaker_failures,
    CASE WHEN breaker = 'OPEN' THEN 'circuit_open' ELSE itself END AS outcome FROM p_met
  UNION ALL SELECT event_id, position, model_name, fallback_for, called_us, breaker, breaker_failures,
    CASE WHEN breaker = 'OPEN' THEN 'circuit_open' ELSE itself END FROM f_met)"""


def _replay_sql(select: str) -> str:
    return "WITH RECURSIVE " + _extended(select, _REPLAY_SQL, "routed").removeprefix("WITH ")


@register(
    "breaker_calls",
    _replay_sql("SELECT event_id, model_name, fallback_for, called_us, breaker, breaker_failures, outcome FROM made"),
)
def breaker_calls_query(spark, sf):
    """Every call of the replay under the default breaker: threshold 5, reset 15 s."""
    return flow.replayed_calls(spark, sf).select(
        "event_id",
        "model_name",
        "fallback_for",
        us("called_at").alias("called_us"),
        "breaker",
        "breaker_failures",
        "outcome",
    )


@register(
    "breaker_predictions",
    _replay_sql(
        """SELECT p.event_id, p.position::INT AS position, coalesce(f.model_name, p.model_name) AS model_name,
  CASE coalesce(f.outcome, p.outcome) WHEN 'success' THEN CASE WHEN f.model_name IS NOT NULL THEN 'fallback'
      WHEN p.model_name LIKE '%_shadow' THEN 'shadow' ELSE 'success' END ELSE coalesce(f.outcome, p.outcome) END AS status,
  f.fallback_for, CASE WHEN f.model_name IS NOT NULL THEN p.outcome END AS primary_status
FROM made p LEFT JOIN made f ON f.event_id = p.event_id AND f.fallback_for = p.model_name WHERE p.fallback_for IS NULL"""
    ),
)
def breaker_predictions_query(spark, sf):
    """Prediction rows behind those calls: failing and refused primaries, failing and refused fallbacks."""
    return flow.replayed_predictions(spark, sf).select(
        "event_id", "position", "model_name", "status", "fallback_for", "primary_status"
    )


@register(
    "counter_calls",
    _replay_sql("SELECT model_name, outcome, count(*) AS calls, count(fallback_for) AS as_fallback FROM made GROUP BY 1, 2"),
)
def counter_calls_query(spark, sf):
    """Attempts, timeouts, errors and refusals per model, with those of primaries a fallback replaced."""
    return M.call_counter(flow.replayed_calls(spark, sf))


@register(
    "collect_predictions",
    sql(
        """SELECT event_id, string_agg(model_name || ':' || status, ',' ORDER BY position) AS predictions, count(*)::INT AS n
FROM preds GROUP BY 1""",
        "preds",
    ),
)
def collect_predictions_query(spark, sf):
    collected = S.collect_predictions(flow.predictions(spark, sf))
    shown = F.transform("predictions", lambda p: F.concat(p["model_name"], F.lit(":"), p["status"]))
    return collected.select("event_id", joined(shown).alias("predictions"), F.size("predictions").alias("n"))


register(
    "model_hash",
    sql(
        """SELECT event_id, position, substring(sha256(model_name || ':' || model_version), 1, 16) AS model_hash
FROM routed""",
        "routed",
    ),
)(
    lambda spark, sf: flow.accepted(spark, sf)
    .select("event_id", F.inline(route_models(F.col("event_type"))))
    .select("event_id", "position", model_hash(F.col("model_name"), F.col("model_version")).alias("model_hash"))
)
register(
    "inference_status",
    sql(
        """SELECT a.event_id, CASE WHEN bool_or(p.status IN ('timeout', 'error')) THEN 'PARTIAL_SUCCESS' ELSE 'INFERENCE' END
  AS inference_status FROM accepted a LEFT JOIN preds p USING (event_id) GROUP BY 1""",
        "preds",
    ),
)(lambda spark, sf: flow.scored_with_calls(spark, sf).select("event_id", "inference_status"))


# --- rules and decision -----------------------------------------------------------------------


def _rule(name: str, rule: Callable[[], Column], column: str) -> None:
    def query(spark, sf):
        hits = flow.scored(spark, sf).select("event_id", rule().alias("r"))
        return hits.filter(F.col("r").isNotNull()).select("event_id", "r.*")

    register(name, sql(f"SELECT event_id, {column}.* FROM rules WHERE {column} IS NOT NULL", "rules"))(query)


for _i, _r in enumerate(D.RULES):
    _rule(_r.__name__, _r, f"r{_i + 1}")


def _explained(spark, sf) -> DataFrame:
    return D.decide(flow.scored(spark, sf))


register(
    "triggered_rules",
    sql(
        "SELECT event_id, array_to_string(names, ',') AS names, array_to_string(reasons, ',') AS reasons FROM fired",
        "fired",
    ),
)(
    lambda spark, sf: _explained(spark, sf).select(
        "event_id", joined("triggered_rules").alias("names"), joined("explanation.rule_reasons").alias("reasons")
    )
)
register(
    "max_severity",
    sql("SELECT event_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][level] AS severity FROM fired", "fired"),
)(
    lambda spark, sf: flow.scored(spark, sf)
    .select("event_id", D.triggered_rules().alias("fired"))
    .select("event_id", D.max_severity(F.col("fired")).alias("severity"))
)
register("decision_score", sql("SELECT event_id, decision_score FROM decided", "decided"))(
    lambda spark, sf: _explained(spark, sf).select("event_id", "decision_score")
)
register("escalate", sql("SELECT event_id, severity FROM decided", "decided"))(
    lambda spark, sf: _explained(spark, sf).select("event_id", "severity")
)
register("decision_confidence", sql("SELECT event_id, confidence FROM decided", "decided"))(
    lambda spark, sf: _explained(spark, sf).select("event_id", "confidence")
)
register("action_for", sql("SELECT event_id, action FROM decided", "decided"))(
    lambda spark, sf: _explained(spark, sf).select("event_id", "action")
)


@register(
    "explanation",
    sql(
        f"""SELECT event_id, 0.45::DOUBLE AS w_anomaly, 0.3::DOUBLE AS w_risk, 0.25::DOUBLE AS w_rules,
  {near("CASE WHEN event_type = 'patient_vital' THEN anomaly ELSE 0.0::DOUBLE END")} AS anomaly,
  {near("CASE WHEN event_type IN ('patient_vital', 'lab_result') THEN risk ELSE 0.0::DOUBLE END")} AS risk,
  {near("rule_score")} AS rules, heart_rate, spo2, respiratory_rate, {near("occupancy_ratio")} AS occupancy_ratio,
  waiting_minutes, false AS partial,
  CASE WHEN event_type = 'patient_vital' THEN 'anomaly_detector_shadow' ELSE '' END AS shadow_models FROM decided""",
        "decided",
    ),
)
def explanation_query(spark, sf):
    e = F.col("explanation")
    return _explained(spark, sf).select(
        "event_id",
        e["weights"]["anomaly_detector"].alias("w_anomaly"),
        e["weights"]["risk_predictor"].alias("w_risk"),
        e["weights"]["rules"].alias("w_rules"),
        six(e["components"]["anomaly"]).alias("anomaly"),
        six(e["components"]["risk"]).alias("risk"),
        six(e["components"]["rules"]).alias("rules"),
        e["features_used"]["heart_rate"].alias("heart_rate"),
        e["features_used"]["spo2"].alias("spo2"),
        e["features_used"]["respiratory_rate"].alias("respiratory_rate"),
        six(e["features_used"]["occupancy_ratio"]).alias("occupancy_ratio"),
        e["features_used"]["waiting_minutes"].alias("waiting_minutes"),
        e["partial"].alias("partial"),
        joined(e["shadow_models"]).alias("shadow_models"),
    )


_DECISION = """id, event_id, patient_id, severity, action, decision_score, confidence,
  array_to_string(names, ',') AS triggered_rules, trace_id, arrival_us AS created_us"""


def _decision_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id",
        "event_id",
        "patient_id",
        "severity",
        "action",
        "decision_score",
        "confidence",
        joined("triggered_rules").alias("triggered_rules"),
        "trace_id",
        us("created_at").alias("created_us"),
    )


register("decide", sql(f"SELECT {_DECISION} FROM decided", "decided"))(
    lambda spark, sf: _decision_columns(D.decide(flow.scored(spark, sf)))
)


@register("dedup_decisions", sql(f"SELECT {_DECISION} FROM decided", "decided"))
def dedup_decisions_query(spark, sf):
    """Every decision arrives a second time, later, as after a restart of the stage."""
    once = flow.decisions(spark, sf)
    late = F.timestamp_micros(us("created_at") + F.lit(5_000_000))
    twice = once.withColumn("created_at", F.explode(F.array(F.col("created_at"), late)))
    return _decision_columns(D.dedup_decisions(twice))


# --- alerts -----------------------------------------------------------------------------------

register("alert_candidates", sql("SELECT event_id, severity, action FROM candidates", "candidates"))(
    lambda spark, sf: A.alert_candidates(flow.decisions(spark, sf)).select("event_id", "severity", "action")
)
register("alert_dedup", sql("SELECT dedup_key, event_id, arrival_us AS created_us FROM alerts", "alerts"))(
    lambda spark, sf: A.alert_dedup(A.alert_candidates(flow.decisions(spark, sf))).select(
        "dedup_key", "event_id", us("created_at").alias("created_us")
    )
)
register(
    "alert_rows",
    sql(
        """SELECT alert_id AS id, event_id, patient_id, action AS alert_type, severity, 'OPEN' AS status, message, dedup_key,
  arrival_us AS created_us FROM alerts""",
        "alerts",
    ),
)(
    lambda spark, sf: flow.alerts(spark, sf).select(
        "id",
        "event_id",
        "patient_id",
        "alert_type",
        "severity",
        "status",
        "message",
        "dedup_key",
        us("created_at").alias("created_us"),
    )
)


@register(
    "alert_outbox",
    sql(
        """SELECT sha256('outbox|' || alert_id) AS id, alert_id AS aggregate_id, 'ALERT_CREATED' AS event_type, true AS published,
  severity, message, event_id FROM alerts""",
        "alerts",
    ),
)
def alert_outbox_query(spark, sf):
    return A.alert_outbox(flow.alerts(spark, sf)).select(
        "id",
        "aggregate_id",
        "event_type",
        "published",
        *[F.get_json_object("payload", f"$.{name}").alias(name) for name in ("severity", "message", "event_id")],
    )


def _alerts_after(spark, sf) -> DataFrame:
    raised = flow.alerts(spark, sf)
    return A.alert_lifecycle(raised, flow.commands(raised))


register(
    "alert_lifecycle",
    sql(
        "SELECT alert_id AS id, status, acknowledged_us, acknowledged_by, resolved_us FROM lifecycle",
        "lifecycle",
    ),
)(
    lambda spark, sf: _alerts_after(spark, sf).select(
        "id",
        "status",
        us("acknowledged_at").alias("acknowledged_us"),
        "acknowledged_by",
        us("resolved_at").alias("resolved_us"),
    )
)

_AUDIT_SQL = """audit AS (
  SELECT trace_id, 'ingestion' AS actor, 'EVENT_VALIDATED' AS action, 'event' AS resource_type, event_id AS resource_id,
    NULL AS severity, arrival_us AS created_us, NULL AS command_id FROM accepted
  UNION ALL SELECT trace_id, 'alert-service', 'ALERT_CREATED', 'alert', alert_id, severity, arrival_us, NULL FROM alerts
  UNION ALL SELECT event_id, acknowledged_by, 'ALERT_ACKNOWLEDGED', 'alert', alert_id, severity, acknowledged_us, NULL
    FROM lifecycle WHERE acknowledged_us IS NOT NULL
  UNION ALL SELECT event_id, actor, 'ALERT_RESOLVED', 'alert', alert_id, NULL, at_us, command_id FROM commands
    WHERE command = 'resolve'),
audited AS (SELECT * EXCLUDE (command_id),
  sha256(concat_ws('|', 'audit', action, resource_id, created_us, command_id)) AS id FROM audit)"""


def _audit(spark, sf) -> DataFrame:
    raised = flow.alerts(spark, sf)
    return A.audit_trail(flow.accepted(spark, sf), raised, flow.commands(raised))


def _audit_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "trace_id",
        "actor",
        "action",
        "resource_type",
        "resource_id",
        F.col("metadata")["severity"].alias("severity"),
        us("created_at").alias("created_us"),
        "id",
    )


register("audit_trail", _extended("SELECT * FROM audited", _AUDIT_SQL, "lifecycle"))(
    lambda spark, sf: _audit_columns(_audit(spark, sf))
)

# Every stage is behind the one before it: only what had arrived by then has passed the stage.
_STAGE_CUTS = ("2024-01-29 00:00:00", "2024-01-25 00:00:00", "2024-01-20 00:00:00", "2024-01-15 00:00:00")


def _status(spark, sf) -> DataFrame:
    events = flow.accepted(spark, sf)
    passed = [F.col("arrival_time") <= at(cut) for cut in _STAGE_CUTS]
    cut_short = flow.predictions(spark, sf).filter(F.col("created_at") <= at(_STAGE_CUTS[1]))
    return A.processing_status(
        events, events.filter(passed[0]), events.filter(passed[1]), cut_short, events.filter(passed[2]), events.filter(passed[3])
    )


_STATUS_SQL = f"""states AS (
  SELECT a.event_id, CASE WHEN arrival_us <= epoch_us(TIMESTAMP '{_STAGE_CUTS[3]}') THEN 'COMPLETED'
    WHEN arrival_us <= epoch_us(TIMESTAMP '{_STAGE_CUTS[2]}') THEN 'DECISION'
    WHEN arrival_us <= epoch_us(TIMESTAMP '{_STAGE_CUTS[1]}')
      THEN CASE WHEN a.event_id IN (SELECT event_id FROM preds WHERE status IN ('timeout', 'error'))
                THEN 'PARTIAL_SUCCESS' ELSE 'INFERENCE' END
    WHEN arrival_us <= epoch_us(TIMESTAMP '{_STAGE_CUTS[0]}') THEN 'FEATURE_EXTRACTION' ELSE 'VALIDATING' END AS status
  FROM accepted a)"""

register("processing_status", _extended("SELECT event_id, status FROM states", _STATUS_SQL, "preds"))(_status)


# --- dashboard --------------------------------------------------------------------------------


@register(
    "event_summary",
    _extended(
        """SELECT a.event_id, s.status, a.event_type, a.patient_id, a.event_us, coalesce(c.n, 0) AS prediction_count,
  d.id AS decision_id, d.severity, d.action, a.trace_id
FROM accepted a JOIN states s USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS n FROM preds GROUP BY 1) c USING (event_id)
LEFT JOIN decided d USING (event_id)""",
        _STATUS_SQL,
        "preds",
        "decided",
    ),
)
def event_summary_query(spark, sf):
    summary = R.event_summary(
        flow.accepted(spark, sf), _status(spark, sf), flow.predictions(spark, sf), flow.decisions(spark, sf)
    )
    return summary.withColumn("event_us", us("timestamp")).drop("timestamp", "payload")


register(
    "recent_events",
    sql(
        """SELECT event_id, event_type, patient_id, event_us, arrival_us, trace_id FROM accepted
ORDER BY arrival_us DESC, event_id DESC LIMIT 200""",
        "accepted",
    ),
)(
    lambda spark, sf: R.recent_events(flow.accepted(spark, sf), 200).select(
        "event_id",
        "event_type",
        "patient_id",
        us("event_time").alias("event_us"),
        us("arrival_time").alias("arrival_us"),
        "trace_id",
    )
)

_FROM, _TO = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


@register(
    "patient_timeline",
    sql(
        f"""SELECT t.patient_id, kind, ref, at_us, detail, severity, position, coalesce(p.display_name, t.patient_id) AS display_name,
  p.ward_id FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id, kind ORDER BY at_us DESC, ref DESC)::INT AS position FROM (
    SELECT patient_id, 'event' AS kind, event_id AS ref, event_us AS at_us, event_type AS detail, NULL AS severity
      FROM accepted WHERE event_us BETWEEN epoch_us(TIMESTAMP '{_FROM}') AND epoch_us(TIMESTAMP '{_TO}')
    UNION ALL SELECT patient_id, 'alert', alert_id, arrival_us, action, severity FROM alerts WHERE severity = 'HIGH'
    UNION ALL SELECT patient_id, 'decision', id, arrival_us, action, severity FROM decided)
  WHERE patient_id IS NOT NULL) t LEFT JOIN patients p ON p.external_ref = t.patient_id WHERE position <= 10""",
        "alerts",
        "patients",
    ),
)
def patient_timeline_query(spark, sf):
    made = flow.decisions(spark, sf)
    rows = R.patient_timeline(
        flow.accepted(spark, sf), A.open_alerts(made), made, patients(spark, sf), at(_FROM), at(_TO), "HIGH", 10
    )
    return rows.withColumn("at_us", us("at")).drop("at")


register(
    "list_alerts",
    sql(
        f"""SELECT alert_id AS id, patient_id, severity, action AS alert_type, status, arrival_us AS created_us FROM lifecycle
WHERE severity = 'HIGH' AND status = 'OPEN' AND action = 'REVIEW_RECOMMENDED'
  AND arrival_us BETWEEN epoch_us(TIMESTAMP '{_FROM}') AND epoch_us(TIMESTAMP '{_TO}')
ORDER BY arrival_us DESC, alert_id DESC LIMIT 50""",
        "lifecycle",
    ),
)(
    lambda spark, sf: R.list_alerts(
        _alerts_after(spark, sf), None, "HIGH", "OPEN", "REVIEW_RECOMMENDED", at(_FROM), at(_TO), 50
    ).select("id", "patient_id", "severity", "alert_type", "status", us("created_at").alias("created_us"))
)
register(
    "list_quarantine",
    sql(
        """SELECT event_id, code AS failure_code, error, arrival_us AS created_us FROM checked
WHERE code IS NOT NULL ORDER BY arrival_us DESC LIMIT 50""",
        "checked",
    ),
)(
    lambda spark, sf: R.list_quarantine(flow.quarantine(spark, sf)).select(
        "event_id", "failure_code", "error", us("created_at").alias("created_us")
    )
)
register(
    "recent_audit",
    _extended("SELECT * FROM audited ORDER BY created_us DESC, id DESC LIMIT 100", _AUDIT_SQL, "lifecycle"),
)(lambda spark, sf: _audit_columns(R.recent_audit(_audit(spark, sf))))
register(
    "list_patients", sql("SELECT external_ref, display_name, ward_id FROM patients ORDER BY external_ref", "patients")
)(lambda spark, sf: R.list_patients(patients(spark, sf)))

register(
    "kpi_events_per_min",
    sql(
        f"""SELECT count(*) AS events_per_min FROM accepted
WHERE arrival_us BETWEEN {AS_OF_US} - 60000000 AND {AS_OF_US}""",
        "accepted",
    ),
)(lambda spark, sf: R.kpi_events_per_min(flow.accepted(spark, sf), at(AS_OF)))
register(
    "kpi_active_patients",
    sql(
        f"""SELECT count(DISTINCT patient_id) AS active_patients FROM accepted
WHERE arrival_us BETWEEN {AS_OF_US} - 3600000000 AND {AS_OF_US}""",
        "accepted",
    ),
)(lambda spark, sf: R.kpi_active_patients(flow.accepted(spark, sf), at(AS_OF)))
register(
    "kpi_open_alerts",
    sql("SELECT count(*) AS open_alerts FROM lifecycle WHERE status IN ('OPEN', 'CREATED')", "lifecycle"),
)(lambda spark, sf: R.kpi_open_alerts(_alerts_after(spark, sf)))
_RATE = "coalesce(avg((status = 'success')::INT), 1.0::DOUBLE)"
register("kpi_model_success_rate", sql(f"SELECT round({_RATE}, 4) AS model_success_rate FROM preds", "preds"))(
    lambda spark, sf: R.kpi_model_success_rate(flow.predictions(spark, sf))
)
register(
    "kpi_alerts_by_severity",
    sql("SELECT severity, count(*) AS alerts FROM lifecycle WHERE status = 'OPEN' GROUP BY 1", "lifecycle"),
)(lambda spark, sf: R.kpi_alerts_by_severity(_alerts_after(spark, sf)))


@register(
    "overview",
    sql(
        f"""SELECT (SELECT count(*) FROM accepted WHERE arrival_us BETWEEN {AS_OF_US} - 60000000 AND {AS_OF_US}) AS events_per_min,
  (SELECT count(DISTINCT patient_id) FROM accepted WHERE arrival_us BETWEEN {AS_OF_US} - 3600000000 AND {AS_OF_US})
    AS active_patients,
  (SELECT count(*) FROM lifecycle WHERE status = 'OPEN') AS open_alerts,
  (SELECT round({_RATE}, 4) FROM preds) AS model_success_rate,
  (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM
     (SELECT severity, count(*) AS n FROM lifecycle WHERE status = 'OPEN' GROUP BY 1)) AS alerts_by_severity""",
        "lifecycle",
        "preds",
    ),
)
def overview_query(spark, sf):
    row = R.overview(flow.accepted(spark, sf), _alerts_after(spark, sf), flow.predictions(spark, sf), at(AS_OF))
    entries = F.transform(
        F.map_entries("alerts_by_severity"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return row.withColumn("alerts_by_severity", joined(entries))


_STATS_SQL = f"""stats AS (
  SELECT model_name, model_version, count, {round_even("rate", 4)} AS success_rate, {round_even("p95", 2)} AS p95_ms FROM (
    SELECT model_name, model_version, count(*) AS count, avg((status = 'success')::INT) AS rate,
      list_sort(list(latency_ms))[floor(0.95 * (count(*) - 1))::INT + 1] AS p95
    FROM preds GROUP BY 1, 2))"""
register("model_stats", _extended("SELECT * FROM stats", _STATS_SQL, "preds"))(
    lambda spark, sf: R.model_stats(flow.predictions(spark, sf))
)


@register(
    "model_panel",
    _extended(
        """SELECT r.*, s.count, s.success_rate, s.p95_ms, coalesce(b.state, 'CLOSED') AS state FROM (VALUES
  ('anomaly_detector', '2.1', 'fallback: threshold_detector', 150), ('threshold_detector', '1.0', 'primary', 20),
  ('risk_predictor', '1.4', 'primary', 200), ('capacity_forecaster', '1.0', 'primary', 80),
  ('imaging_prioritizer', '1.0', 'primary', 60), ('data_quality_scorer', '1.0', 'primary', 40),
  ('anomaly_detector_shadow', '2.2-shadow', 'shadow', 150)) r(model_name, model_version, mode, timeout_ms)
LEFT JOIN stats s USING (model_name, model_version) LEFT JOIN breakers b USING (model_name)""",
        _STATS_SQL + ",\n" + _BREAKER_SQL,
        "preds",
    ),
)
def model_panel_query(spark, sf):
    return R.model_panel(R.model_stats(flow.predictions(spark, sf)), _breakers(spark, sf))


register(
    "alert_feed",
    sql(
        """SELECT alert_id AS id, severity, action AS alert_type, message, arrival_us AS created_us FROM alerts
ORDER BY arrival_us DESC, alert_id DESC LIMIT 40""",
        "alerts",
    ),
)(
    lambda spark, sf: R.alert_feed(flow.alerts(spark, sf))
    .withColumn("created_us", us("created_at"))
    .drop("created_at")
)


# --- metrics ----------------------------------------------------------------------------------

register("counter_ingested", sql("SELECT event_type, count(*) AS count FROM accepted GROUP BY 1", "accepted"))(
    lambda spark, sf: M.counter_by_label(flow.accepted(spark, sf), ["event_type"])
)
register(
    "counter_quarantine",
    sql("SELECT code AS failure_code, count(*) AS count FROM checked WHERE code IS NOT NULL GROUP BY 1", "checked"),
)(lambda spark, sf: M.counter_by_label(flow.quarantine(spark, sf), ["failure_code"]))
register(
    "counter_predictions", sql("SELECT model_name, status, count(*) AS count FROM preds GROUP BY 1, 2", "preds")
)(lambda spark, sf: M.counter_by_label(flow.predictions(spark, sf), ["model_name", "status"]))
register(
    "counter_alerts",
    sql("SELECT severity, action AS alert_type, count(*) AS count FROM alerts GROUP BY 1, 2", "alerts"),
)(lambda spark, sf: M.counter_by_label(flow.alerts(spark, sf), ["severity", "alert_type"]))

_BOUNDS = ", ".join(f"({b}::DOUBLE, '{b}')" for b in M.MODEL_BUCKETS)
register(
    "latency_histogram",
    sql(
        f"""SELECT model_name, b.le, count(*) FILTER (WHERE call_ms / 1000.0::DOUBLE <= b.bound) AS count
FROM outcomes, (VALUES {_BOUNDS}, ('inf'::DOUBLE, '+Inf')) b(bound, le) GROUP BY 1, 2""",
        "outcomes",
    ),
)(
    lambda spark, sf: M.latency_histogram(
        flow.call_log(spark, sf), ["model_name"], F.col("latency_ms") / 1000.0, M.MODEL_BUCKETS
    )
)


def _histogram_sql(label: str, seconds: str, buckets: tuple[float, ...], rows: str) -> str:
    bounds = ", ".join(f"({b}::DOUBLE, '{b}')" for b in buckets)
    return f"""SELECT {label}, b.le, count(*) FILTER (WHERE {seconds} <= b.bound) AS count
FROM {rows}, (VALUES {bounds}, ('inf'::DOUBLE, '+Inf')) b(bound, le) GROUP BY 1, 2"""


_LATE_SQL = "(arrival_us - event_us) / 1000000.0::DOUBLE"
register(
    "latency_histogram_stage",
    sql(_histogram_sql("event_type", _LATE_SQL, M.STAGE_BUCKETS, "accepted"), "accepted"),
)(
    lambda spark, sf: M.latency_histogram(
        flow.accepted(spark, sf),
        ["event_type"],
        seconds_between(F.col("arrival_time"), F.col("event_time")),
        M.STAGE_BUCKETS,
    )
)
register(
    "latency_histogram_end_to_end",
    sql(_histogram_sql("severity", _LATE_SQL, M.END_TO_END_BUCKETS, "alerts"), "alerts"),
)(
    # From the event's own time to its alert; the alert table has no event time, so it joins the events.
    lambda spark, sf: M.latency_histogram(
        flow.alerts(spark, sf)
        .select("event_id", "severity", "created_at")
        .join(flow.accepted(spark, sf).select("event_id", "event_time"), "event_id"),
        ["severity"],
        seconds_between(F.col("created_at"), F.col("event_time")),
        M.END_TO_END_BUCKETS,
    )
)
register(
    "counter_rate",
    sql(
        f"""SELECT severity, start_us, {near("count(*) / 60.0::DOUBLE")} AS rate FROM (
  SELECT severity, (arrival_us // 15000000 - s.i) * 15000000 AS start_us FROM alerts, (VALUES (0), (1), (2), (3)) s(i))
GROUP BY 1, 2""",
        "alerts",
    ),
)(
    lambda spark, sf: M.counter_rate(flow.alerts(spark, sf), ["severity"], "created_at").select(
        "severity", us("window_start").alias("start_us"), six("rate").alias("rate")
    )
)

_Q_BUCKETS = M.MODEL_BUCKETS


def _quantile_sql() -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE s <= {b}) AS c{i}" for i, b in enumerate(_Q_BUCKETS))
    listed = ", ".join(f"c{i}" for i in range(len(_Q_BUCKETS)))
    bounds = ", ".join(f"{b}::DOUBLE" for b in _Q_BUCKETS)
    return f"""SELECT model_name, start_us, {near('''CASE WHEN i IS NULL THEN bounds[-1] ELSE
  (CASE WHEN i = 1 THEN 0 ELSE bounds[i - 1] END) + (bounds[i] - CASE WHEN i = 1 THEN 0 ELSE bounds[i - 1] END)
  * (wanted - CASE WHEN i = 1 THEN 0 ELSE counts[i - 1] END) / (counts[i] - CASE WHEN i = 1 THEN 0 ELSE counts[i - 1] END) END''')}
  AS quantile FROM (
  SELECT *, list_position(list_transform(counts, lambda c: c >= wanted), true) AS i FROM (
    SELECT model_name, start_us, [{listed}] AS counts, [{bounds}] AS bounds, n * 0.95::DOUBLE AS wanted FROM (
      SELECT model_name, arrival_us // 86400000000 * 86400000000 AS start_us, count(*) AS n, {cells}
      FROM (SELECT *, call_ms / 1000.0::DOUBLE AS s FROM outcomes) GROUP BY 1, 2)))"""


register("histogram_quantile", sql(_quantile_sql(), "outcomes"))(
    lambda spark, sf: M.histogram_quantile(
        flow.call_log(spark, sf), ["model_name"], "called_at", F.col("latency_ms") / 1000.0, _Q_BUCKETS, 0.95, "1 day"
    ).select("model_name", us("window_start").alias("start_us"), six("quantile").alias("quantile"))
)


@register(
    "quota_flag",
    """SELECT user_id, event_id, request_number, greatest(0, 2 - request_number)::BIGINT AS remaining,
  request_number > 2 AS refused FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id)
    AS request_number FROM events)""",
)
def quota_flag_query(spark, sf):
    """At most two requests per user and day: the tables hold a few requests per user and day."""
    requests = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    flagged = M.quota_flag(requests, "user_id", "ts", "event_id", replace(flow.WIDE, requests_per_minute=2), 86_400)
    return flagged.drop("ts")


# --- streams: the tables left by the streaming queries after all messages -----------------------


def _streamed(spark, sf, name: str) -> DataFrame:
    return spark.read.parquet(f"{flow.stream_tables(spark, sf)}/{name}")


register(
    "stream_validate",
    sql(
        """SELECT event_id, code AS failure_code, error, arrival_us AS created_us FROM checked WHERE code IS NOT NULL""",
        "checked",
    ),
)(
    lambda spark, sf: _streamed(spark, sf, "quarantine").select(
        "event_id", "failure_code", "error", us("created_at").alias("created_us")
    )
)
register("stream_dedup", sql("SELECT event_id, source_id, arrival_us FROM accepted", "accepted"))(
    lambda spark, sf: _streamed(spark, sf, "accepted").select(
        "event_id", "source_id", us("arrival_time").alias("arrival_us")
    )
)
register("stream_features", ORACLE["feature_vector"])(
    lambda spark, sf: _vector_columns(_streamed(spark, sf, "vectors"))
)
register("stream_score_decide", sql(f"SELECT {_DECISION} FROM decided", "decided"))(
    lambda spark, sf: _decision_columns(_streamed(spark, sf, "decisions"))
)
register("stream_alerts", sql("SELECT dedup_key FROM alerts", "alerts"))(
    lambda spark, sf: _streamed(spark, sf, "alerts").select("dedup_key")
)
register(
    "stream_lateness",
    sql(
        """SELECT event_id, (arrival_us - event_us) > 120000000 AS stale, arrival_us - event_us AS late_us FROM accepted""",
        "accepted",
    ),
)(
    lambda spark, sf: _streamed(spark, sf, "accepted").select(
        "event_id",
        (us("arrival_time") - us("event_time") > flow.WIDE.lateness_s * 1_000_000).alias("stale"),
        (us("arrival_time") - us("event_time")).alias("late_us"),
    )
)


@register(
    "stream_kpis",
    sql(
        """SELECT arrival_us // 60000000 * 60000000 AS minute_us, count(*) AS events,
  count(*) FILTER (WHERE arrival_us - event_us > 120000000) AS stale,
  count(DISTINCT nullif(patient_id, '')) AS patients FROM accepted GROUP BY 1""",
        "accepted",
    ),
)
def stream_kpis_query(spark, sf):
    """Per-minute KPIs kept up to date by a stream over the accepted events."""
    accepted = flow.accepted(spark, sf).select("event_id", "patient_id", "event_time", "arrival_time")
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-kpis"
    # Four files in no order of time, one micro-batch each: most minutes get rows from several.
    accepted.repartition(4, "event_id").write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(accepted.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    run_kpis(stream, f"{folder}/kpis", f"{folder}/checkpoint").awaitTermination()
    return kpis(spark, f"{folder}/kpis").select(us("window_start").alias("minute_us"), "events", "stale", "patients")


def _dealt(spark, folder: str, rows: dict[str, tuple[DataFrame, str]]) -> list[DataFrame]:
    """Each table as a stream of four files in no order, one file per micro-batch."""
    streams = []
    for name, (df, key) in rows.items():
        df.repartition(4, key).write.parquet(f"{folder}/{name}")
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}"))
    return streams


def _stream_replayed(spark, sf) -> str:
    """Streams over all messages, then requests for every record refused for its clock, half of them made twice, then the replays."""

    def run(folder: str) -> None:
        wire_events(spark, sf).write.parquet(f"{folder}/messages")
        raw = spark.readStream.schema("value string, arrival_time timestamp").parquet(f"{folder}/messages")
        # Nothing is replayed yet; the query is started again below with both sources.
        spark.createDataFrame([], REPLAYS).withColumn("batch_id", F.lit(-1)).write.parquet(f"{folder}/replays")

        def events() -> StreamingQuery:
            source = raw.unionByName(replayed_messages(spark, folder))
            return run_events(source, folder, f"{folder}/checkpoint", flow.fixed_scorers(), flow.WIDE, flow.with_fixed_raw)

        with shuffled_by(spark, spread_partitions(table(spark, sf, "events"))):
            refused = run_quarantine(raw, folder, f"{folder}/checkpoint-quarantine", flow.WIDE)
            events().awaitTermination()
            refused.awaitTermination()
            held = spark.read.parquet(f"{folder}/quarantine").filter(F.col("failure_code") == "CLOCK_SKEW")
            asked = held.select("id", F.timestamp_micros(us("created_at") + 3_600_000_000).alias("requested_at"))
            asked = asked.unionByName(asked.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0))
            run_replays(*_dealt(spark, folder, {"requests": (asked, "id")}), folder, f"{folder}/checkpoint-replays").awaitTermination()
            events().awaitTermination()

    return flow.written_folder(spark, sf, "stream-replay", run)


register("stream_replay", ORACLE["replay_quarantine"])(
    lambda spark, sf: spark.read.parquet(f"{_stream_replayed(spark, sf)}/accepted")
    .join(
        spark.read.schema(REPLAYS).parquet(f"{_stream_replayed(spark, sf)}/replays").select("event_id", "arrival_time"),
        ["event_id", "arrival_time"],
        "left_semi",
    )
    .select("event_id", "source_id", us("arrival_time").alias("arrival_us"))
)
register("stream_replay_marks", ORACLE["replay_marks"])(
    lambda spark, sf: marked_quarantine(spark, _stream_replayed(spark, sf))
    .filter(F.col("batch_id") == 0)
    .select("event_id", "failure_code", us("created_at").alias("created_us"), "replayed")
)


@register(
    "stream_open_alerts",
    sql("SELECT severity, count(*) AS alerts FROM lifecycle WHERE status = 'OPEN' GROUP BY 1", "lifecycle"),
)
def stream_open_alerts_query(spark, sf):
    """Open alerts by severity, kept by adding openings and taking off those that a command ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-open"
    raised = flow.alerts(spark, sf).select("id", "severity", "status", "event_id", "created_at")
    streams = _dealt(spark, folder, {"alerts": (raised, "id"), "commands": (flow.commands(raised), "command_id")})
    with shuffled_by(spark, spread_partitions(raised)):
        run_open_alerts(*streams, f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return open_alerts_by_severity(spark, f"{folder}/changes")


@register(
    "stream_model_stats",
    _extended(
        "SELECT model_name, model_version, count, success_rate, true AS p95_holds FROM stats", _STATS_SQL, "preds"
    ),
)
def stream_model_stats_query(spark, sf):
    """Statistics per model from stored parts; the sketch's p95 stands within 1 % of its rank among all latencies."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-stats"
    rows = flow.predictions(spark, sf).select("id", "model_name", "model_version", "status", "latency_ms", "created_at")
    run_model_stats(*_dealt(spark, folder, {"predictions": (rows, "id")}), f"{folder}/parts", f"{folder}/checkpoint").awaitTermination()
    stats = stored_model_stats(spark, f"{folder}/parts")
    latency = F.coalesce("latency_ms", F.lit(0.0))
    # One row per model, read against all predictions.
    ranks = rows.join(F.broadcast(stats), ["model_name", "model_version"]).groupBy(*stats.columns).agg(
        F.avg((latency < F.col("p95_ms") - 0.006).cast("double")).alias("_below"),
        F.avg((latency <= F.col("p95_ms") + 0.006).cast("double")).alias("_upto"),
    )
    holds = (F.col("_below") <= R.MODEL_QUANTILE + 0.01) & (F.col("_upto") >= R.MODEL_QUANTILE - 0.01)
    return ranks.select("model_name", "model_version", "count", "success_rate", holds.alias("p95_holds"))


@register(
    "stream_latest_features",
    sql(
        """SELECT patient_id, event_id, 1706745600000000 + n * 1000000 AS arrival_us, heart_rate FROM feat
WHERE nullif(patient_id, '') IS NOT NULL AND n > (SELECT max(n) FROM feat) + 10 - 120
QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY n DESC) = 1""",
        "feat",
    ),
)
def stream_latest_features_query(spark, sf):
    """The stored latest vectors, replayed at one event number a second in four lots in no order, ten seconds after the last."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-latest"
    start = F.unix_seconds(at("2024-02-01"))
    replayed = flow.vectors(spark, sf).withColumn(
        "arrival_time", F.timestamp_seconds(start + flow.event_number(F.col("event_id")))
    )
    replayed.repartition(4, "event_id").write.parquet(f"{folder}/vectors")
    stream = spark.readStream.schema(replayed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/vectors")
    run_latest_features(stream, f"{folder}/latest", f"{folder}/checkpoint", compact_every=2).awaitTermination()
    last = spark.read.parquet(f"{folder}/vectors").agg(F.max("arrival_time")).first()[0]
    now = F.lit(last).cast("timestamp") + F.expr("interval 10 seconds")
    latest = stored_latest_features(spark, f"{folder}/latest", replayed.schema, now)
    return latest.select("patient_id", "event_id", us("arrival_time").alias("arrival_us"), F.col("features.heart_rate").alias("heart_rate"))


@register(
    "stream_alert_lifecycle",
    sql(
        "SELECT alert_id AS id, status, acknowledged_us, acknowledged_by, resolved_us FROM lifecycle",
        "lifecycle",
    ),
)
def stream_alert_lifecycle_query(spark, sf):
    """Alerts and commands as two streams of four files each in no order, one file of each per micro-batch."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-lifecycle"
    raised = flow.alerts(spark, sf)
    streams = []
    for name, rows, key in (("alerts", raised.select("id", "status"), "id"), ("commands", flow.commands(raised), "command_id")):
        rows.repartition(4, key).write.parquet(f"{folder}/{name}")
        reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
        streams.append(reader.parquet(f"{folder}/{name}"))
    with shuffled_by(spark, spread_partitions(raised)):
        run_alert_lifecycle(*streams, f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return alert_states(spark, f"{folder}/states").select(
        "id",
        "status",
        us("acknowledged_at").alias("acknowledged_us"),
        "acknowledged_by",
        us("resolved_at").alias("resolved_us"),
    )
