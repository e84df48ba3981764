"""DuckDB SQL for the registered queries, written against the tables and not from the Spark plans.

Each query is ``WITH`` the shared steps it needs, then its own SELECT.
"""

from __future__ import annotations

WINDOW_MS = 259_200_000


def round_even(x: str, digits: int) -> str:
    """Round the binary value of a double column half to even (exact product error decides ties)."""
    scale = f"{float(10**digits)}::DOUBLE"
    split = f"({x} * 134217729::DOUBLE)"
    high = f"({split} - ({split} - {x}))"
    error = f"(({high} * {scale} - {x} * {scale}) + ({x} - {high}) * {scale})"
    base = f"floor({x} * {scale})"
    side = f"(({x} * {scale} - {base} - 0.5::DOUBLE) + {error})"
    up = f"CASE WHEN {side} > 0 OR ({side} = 0 AND {base} % 2 = 1) THEN 1::DOUBLE ELSE 0::DOUBLE END"
    return f"(({base} + {up}) / {scale})"


def near(x: str) -> str:
    """Six digits, nudged off exact ties so that the order of a sum does not show."""
    return f"round({x} + 1e-9, 6)"


STEPS: dict[str, str] = {}

STEPS["typed"] = """
SELECT event_id AS n, ts, user_id, value, k,
  CASE WHEN event_id % 10 < 6 THEN 'patient_vital' WHEN event_id % 10 = 6 THEN 'device_reading'
       WHEN event_id % 10 = 7 THEN 'lab_result' WHEN event_id % 10 = 8 THEN 'imaging_request'
       WHEN event_id % 30 = 9 THEN 'bed_status' WHEN event_id % 30 = 19 THEN 'resource_update'
       ELSE 'appointment_event' END AS event_type
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""

STEPS["wire"] = """
SELECT t.n, t.k, t.value, t.event_type, t.ts AS event_time,
  'evt_' || t.n AS event_id,
  CASE WHEN c.copy = 2 THEN 'src_copy' ELSE 'src_' || (t.n % 17) END AS source_id,
  CASE WHEN t.event_type IN ('bed_status', 'resource_update') OR t.n % 97 = 0 THEN NULL
       WHEN t.n % 103 = 0 THEN repeat('p', 120) ELSE 'pat_' || t.user_id END AS patient_id,
  CASE WHEN t.event_type = 'device_reading' AND t.n % 101 <> 0 THEN 'dev_' || (t.n % 23) END AS device_id,
  CASE WHEN t.event_type = 'bed_status' THEN 'ward_' || (t.n % 12)
       WHEN t.event_type = 'resource_update' THEN 'res_' || (t.n % 12) END AS resource_id,
  CAST(CASE WHEN t.n % 71 = 0 THEN 9 ELSE 1 + t.n % 2 END AS INT) AS schema_version,
  CASE WHEN t.n % 67 = 0 THEN 'short' ELSE 'trace' || lpad(t.n::VARCHAR, 8, '0') END AS trace_id,
  epoch_us(t.ts) AS event_us,
  epoch_us(t.ts) + 1000000::BIGINT * (c.copy + CASE WHEN t.n % 89 = 0 THEN -600 WHEN t.n % 83 = 0 THEN 90000
                                            ELSE t.k * 2 END) AS arrival_us,
  CASE WHEN t.n % 11 <> 0 THEN 60.0::DOUBLE + t.value END AS hr,
  CASE WHEN t.n % 13 <> 0 THEN 100.0::DOUBLE - t.k / 5.0::DOUBLE END AS spo2,
  (10 + t.k % 25)::DOUBLE AS rr, 36.0::DOUBLE + t.k / 50.0::DOUBLE AS temp,
  (100 + t.k % 40)::DOUBLE AS sbp, (60 + t.k % 30)::DOUBLE AS dbp,
  CASE t.k % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'occupied' WHEN 2 THEN 'cleaning' ELSE 'blocked' END AS bed,
  CASE WHEN t.n % 7 <> 0 THEN t.k / 100.0::DOUBLE END AS ratio,
  CASE t.k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS acuity,
  CASE t.n % 5 WHEN 0 THEN 'CT' WHEN 1 THEN 'MRI' WHEN 2 THEN 'XRAY' WHEN 3 THEN 'US' ELSE 'PET' END AS modality,
  (t.k * 2)::BIGINT AS waiting, (t.k % 20)::BIGINT AS available,
  CASE WHEN t.n % 19 = 0 THEN 0 ELSE 20 END::BIGINT AS capacity,
  t.n % 7 <> 0 AND t.k >= 80 AS abnormal
FROM typed t JOIN (VALUES (0), (1), (2)) c(copy)
  ON c.copy = 0 OR (c.copy = 1 AND t.n % 20 = 0) OR (c.copy = 2 AND t.n % 40 = 0)"""

STEPS["judged"] = """
SELECT *, CASE
    WHEN length(trace_id) < 8 THEN 'invalid event: trace_id'
    WHEN schema_version NOT BETWEEN 1 AND 2 THEN 'invalid event: schema_version'
    WHEN n % 73 = 0 THEN 'timestamp is not ISO-8601'
    WHEN n % 79 = 0 THEN 'timestamp must be timezone-aware'
    WHEN event_us - arrival_us > 300 * 1000000 THEN 'event timestamp is too far in the future'
    WHEN arrival_us - event_us > 86400 * 1000000::BIGINT THEN 'event timestamp is too old'
    WHEN event_type IN ('patient_vital', 'device_reading', 'lab_result') AND patient_id IS NULL
      THEN event_type || ' requires patient_id'
    WHEN event_type = 'device_reading' AND device_id IS NULL THEN 'device_reading requires device_id'
    WHEN event_type = 'patient_vital' AND hr > 300 THEN 'invalid payload: heart_rate'
    WHEN n % 61 = 0 THEN 'invalid payload: unexpected field'
    WHEN length(patient_id) > 100 THEN 'entity id is longer than the stored column'
  END AS error
FROM wire"""

STEPS["checked"] = """
SELECT *, CASE WHEN error IS NULL THEN NULL WHEN error LIKE '%too far in the future' THEN 'CLOCK_SKEW'
               WHEN error LIKE 'entity id%' THEN 'PERMANENT_FAILURE' ELSE 'INVALID_SCHEMA' END AS code
FROM judged"""

STEPS["accepted"] = """
SELECT * FROM checked WHERE code IS NULL
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_us, source_id) = 1"""

STEPS["hist"] = f"""
SELECT *, count(*) OVER w AS events,
  avg(v_hr) OVER w AS hr_mean, min(v_hr) OVER w AS hr_min, max(v_hr) OVER w AS hr_max, var_pop(v_hr) OVER w AS hr_var,
  count(v_hr) OVER w AS hr_n, first_value(v_hr IGNORE NULLS) OVER w AS hr_first,
  last_value(v_hr IGNORE NULLS) OVER w AS hr_last,
  avg(v_spo2) OVER w AS spo2_mean, min(v_spo2) OVER w AS spo2_min,
  first_value(v_spo2 IGNORE NULLS) OVER w AS spo2_first, avg(v_rr) OVER w AS rr_mean,
  count(*) FILTER (WHERE event_type = 'bed_status' AND bed = 'occupied') OVER w AS occupied,
  count(*) FILTER (WHERE event_type = 'bed_status' AND bed = 'available') OVER w AS free_beds,
  avg(v_ratio) OVER w AS ratio_mean
FROM (SELECT *, CASE WHEN event_type = 'patient_vital' THEN hr END AS v_hr,
        CASE WHEN event_type = 'patient_vital' THEN spo2 END AS v_spo2,
        CASE WHEN event_type = 'patient_vital' THEN rr END AS v_rr,
        CASE WHEN event_type = 'bed_status' THEN ratio END AS v_ratio,
        coalesce('p:' || patient_id, 'e:' || event_id) AS who, event_us // 1000 AS at_ms
      FROM accepted)
WINDOW w AS (PARTITION BY who, event_type ORDER BY at_ms RANGE BETWEEN {WINDOW_MS} PRECEDING AND CURRENT ROW)"""

# Arrivals put off by up to 59 hours, so that most windows have events that had not come yet.
STEPS["put_off"] = """
SELECT *, arrival_us + (n * 7 % 60) * 3600000000 AS came_us, event_us // 1000 AS at_ms,
  coalesce('p:' || patient_id, 'e:' || event_id) AS who, CASE WHEN event_type = 'patient_vital' THEN hr END AS v_hr,
  CASE WHEN event_type = 'patient_vital' THEN spo2 END AS v_spo2 FROM accepted"""

STEPS["hist_arrived"] = f"""
SELECT e.event_id, count(*) AS events, avg(x.v_hr) AS hr_mean, min(x.v_hr) AS hr_min, max(x.v_hr) AS hr_max,
  var_pop(x.v_hr) AS hr_var, count(x.v_hr) AS hr_n,
  first(x.v_hr ORDER BY x.at_ms, x.event_id) FILTER (WHERE x.v_hr IS NOT NULL) AS hr_first,
  last(x.v_hr ORDER BY x.at_ms, x.event_id) FILTER (WHERE x.v_hr IS NOT NULL) AS hr_last, min(x.v_spo2) AS spo2_min
FROM put_off e JOIN put_off x ON x.who = e.who AND x.event_type = e.event_type
  AND x.at_ms BETWEEN e.at_ms - {WINDOW_MS} AND e.at_ms
  AND (x.came_us < e.came_us OR x.came_us = e.came_us AND x.event_id <= e.event_id)
GROUP BY e.event_id"""

STEPS["feat"] = """
SELECT event_id, event_type, patient_id, resource_id, source_id, trace_id, arrival_us, event_us, n, events,
  v_hr AS heart_rate, v_spo2 AS spo2, v_rr AS respiratory_rate,
  CASE WHEN event_type = 'patient_vital' THEN temp END AS temperature_c,
  CASE WHEN event_type = 'patient_vital' THEN sbp END AS systolic_bp,
  CASE WHEN event_type = 'patient_vital' THEN dbp END AS diastolic_bp,
  hr_mean AS heart_rate_mean_5m, hr_min AS heart_rate_min_5m, hr_max AS heart_rate_max_5m,
  hr_var AS hr_variance_5m, CASE WHEN hr_n > 1 THEN (hr_last - hr_first) / (hr_n - 1) END AS hr_slope_5m,
  spo2_mean AS spo2_mean_5m, spo2_min AS spo2_min_5m, v_spo2 - spo2_first AS spo2_delta_5m, rr_mean AS rr_mean_5m,
  CASE WHEN event_type = 'patient_vital' THEN events END AS observation_count,
  CASE event_type
    WHEN 'patient_vital' THEN ((v_hr IS NULL)::INT + (v_spo2 IS NULL)::INT + (v_rr IS NULL)::INT) / 3.0::DOUBLE
    WHEN 'bed_status' THEN (ratio IS NULL)::INT::DOUBLE ELSE 0.0::DOUBLE END AS missing_ratio,
  CASE event_type WHEN 'bed_status' THEN ratio
    WHEN 'resource_update' THEN 1.0::DOUBLE - available::DOUBLE / (CASE WHEN capacity = 0 THEN 1 ELSE capacity END)
    END AS occupancy_ratio,
  CASE event_type WHEN 'bed_status' THEN occupied
    WHEN 'resource_update' THEN (CASE WHEN capacity = 0 THEN 1 ELSE capacity END) - available END AS occupied_count,
  CASE event_type WHEN 'bed_status' THEN free_beds WHEN 'resource_update' THEN available END AS available_count,
  CASE WHEN event_type = 'bed_status' THEN ratio_mean END AS occupancy_mean,
  CASE WHEN event_type = 'imaging_request' THEN waiting END AS waiting_minutes,
  CASE WHEN event_type = 'imaging_request'
    THEN CASE coalesce(acuity, 'medium') WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END END AS acuity_code,
  CASE WHEN event_type = 'imaging_request' THEN CASE modality WHEN 'XRAY' THEN 1 WHEN 'US' THEN 2 WHEN 'CT' THEN 3
    WHEN 'MRI' THEN 4 ELSE 5 END END AS modality_code,
  CASE WHEN event_type = 'lab_result' THEN value END AS lab_value,
  CASE WHEN event_type = 'lab_result' THEN abnormal::INT END AS abnormal_flag,
  arrival_us - event_us > 120 * 1000000 AS stale,
  event_type = 'patient_vital' AND events < 3 AS insufficient
FROM hist"""

STEPS["model_scores"] = """
SELECT *,
  (coalesce(heart_rate > 120 OR heart_rate < 45, false))::INT + (coalesce(spo2 < 92, false))::INT
    + (coalesce(respiratory_rate > 26, false))::INT AS hits,
  1.0::DOUBLE / (1.0::DOUBLE + exp(-((abs(coalesce(heart_rate, 80.0::DOUBLE) - 80.0::DOUBLE) * 0.004::DOUBLE
    + abs(coalesce(spo2, 98.0::DOUBLE) - 98.0::DOUBLE) * 0.02::DOUBLE - 0.15::DOUBLE) - 0.05::DOUBLE) * 4.0::DOUBLE)) AS anomaly,
  1.0::DOUBLE / (1.0::DOUBLE + exp(-(17.0::DOUBLE + 0.02::DOUBLE * coalesce(heart_rate, 80.0::DOUBLE)
    + -0.35::DOUBLE * coalesce(spo2, 98.0::DOUBLE) + 0.18::DOUBLE * coalesce(respiratory_rate, 16.0::DOUBLE)
    + 0.2::DOUBLE * coalesce(temperature_c, 36.8::DOUBLE) + 0.01::DOUBLE * coalesce(systolic_bp, 120.0::DOUBLE)
    + 0.02::DOUBLE * coalesce(heart_rate, 80.0::DOUBLE)))) AS risk,
  least(1.0::DOUBLE, coalesce(occupancy_ratio, 0.5::DOUBLE) * 1.05::DOUBLE
    + 0.05::DOUBLE * coalesce(occupied_count, 0)::DOUBLE / 20.0::DOUBLE) AS capacity_score,
  least(1.0::DOUBLE, coalesce(waiting_minutes, 0)::DOUBLE / 180.0::DOUBLE * 0.5::DOUBLE
    + coalesce(acuity_code, 2)::DOUBLE / 3.0::DOUBLE * 0.35::DOUBLE
    + coalesce(modality_code, 2)::DOUBLE / 5.0::DOUBLE * 0.15::DOUBLE) AS imaging,
  least(1.0::DOUBLE, missing_ratio * 0.5::DOUBLE + stale::INT::DOUBLE * 0.3::DOUBLE
    + insufficient::INT::DOUBLE * 0.2::DOUBLE) AS quality
FROM feat"""

STEPS["scores"] = """
SELECT *, least(1.0::DOUBLE, hits / 3.0::DOUBLE + CASE WHEN hits > 0 THEN 0.35::DOUBLE ELSE 0.05::DOUBLE END) AS threshold,
  least(0.99::DOUBLE, abs(anomaly - 0.5::DOUBLE) * 1.8::DOUBLE + 0.4::DOUBLE) AS anomaly_confidence,
  greatest(risk, 1.0::DOUBLE - risk) AS risk_confidence
FROM model_scores"""

STEPS["routed"] = """
SELECT s.*, r.position, r.model_name, r.model_version
FROM scores s JOIN (VALUES
  ('patient_vital', 0, 'anomaly_detector', '2.1'), ('patient_vital', 1, 'risk_predictor', '1.4'),
  ('patient_vital', 2, 'data_quality_scorer', '1.0'), ('patient_vital', 3, 'anomaly_detector_shadow', '2.2-shadow'),
  ('device_reading', 0, 'data_quality_scorer', '1.0'), ('bed_status', 0, 'capacity_forecaster', '1.0'),
  ('bed_status', 1, 'data_quality_scorer', '1.0'), ('imaging_request', 0, 'imaging_prioritizer', '1.0'),
  ('lab_result', 0, 'risk_predictor', '1.4'), ('lab_result', 1, 'data_quality_scorer', '1.0'),
  ('resource_update', 0, 'capacity_forecaster', '1.0')
) r(kind, position, model_name, model_version) ON r.kind = s.event_type"""

STEPS["answers"] = """
SELECT *,
  CASE WHEN model_name LIKE 'anomaly%' THEN anomaly WHEN model_name = 'risk_predictor' THEN risk
       WHEN model_name = 'data_quality_scorer' THEN quality WHEN model_name = 'capacity_forecaster' THEN capacity_score
       ELSE imaging END AS score,
  CASE WHEN model_name LIKE 'anomaly%' THEN CASE WHEN anomaly >= 0.65 THEN 'anomalous' ELSE 'nominal' END
       WHEN model_name = 'risk_predictor' THEN CASE WHEN risk >= 0.55 THEN 'elevated_risk' ELSE 'low_risk' END
       WHEN model_name = 'data_quality_scorer'
         THEN CASE WHEN quality >= 0.4 THEN 'data_quality_issue' ELSE 'quality_ok' END
       WHEN model_name = 'capacity_forecaster'
         THEN CASE WHEN capacity_score >= 0.85 THEN 'congestion' ELSE 'stable' END
       ELSE CASE WHEN imaging >= 0.6 THEN 'prioritize' ELSE 'routine' END END AS label,
  CASE WHEN model_name LIKE 'anomaly%' THEN anomaly_confidence WHEN model_name = 'risk_predictor' THEN risk_confidence
       WHEN model_name = 'data_quality_scorer' THEN 0.9::DOUBLE WHEN model_name = 'capacity_forecaster'
         THEN 0.8::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
  CASE model_name WHEN 'anomaly_detector' THEN 150 WHEN 'risk_predictor' THEN 200 WHEN 'capacity_forecaster' THEN 80
       WHEN 'imaging_prioritizer' THEN 60 WHEN 'data_quality_scorer' THEN 40 ELSE 150 END AS limit_ms,
  ((n * 7 + position * 31) % 260) + (n % 8) / 8.0::DOUBLE AS call_ms
FROM routed"""

STEPS["outcomes"] = """
SELECT *, CASE WHEN n % 211 = 0 THEN 'circuit_open' WHEN call_ms > limit_ms THEN 'timeout'
               WHEN n % 53 = 0 THEN 'error' ELSE 'success' END AS outcome
FROM answers"""

# The table of predictions of the logged run: a failed anomaly detector is replaced by its fallback.
STEPS["preds"] = """
SELECT event_id, event_type, n, arrival_us, position,
  CASE WHEN swapped THEN 'threshold_detector' ELSE model_name END AS model_name,
  CASE WHEN swapped THEN '1.0' ELSE model_version END AS model_version,
  CASE WHEN swapped THEN threshold WHEN outcome = 'success' THEN score END AS score,
  CASE WHEN swapped THEN CASE WHEN hits > 0 THEN 'anomalous' ELSE 'nominal' END
       WHEN outcome = 'success' THEN label END AS label,
  CASE WHEN swapped THEN CASE WHEN hits > 0 THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END
       WHEN outcome = 'success' THEN confidence END AS confidence,
  CASE WHEN swapped OR outcome = 'circuit_open' THEN 0.0::DOUBLE ELSE least(call_ms, limit_ms) END AS latency_ms,
  CASE WHEN swapped THEN 'fallback' WHEN outcome = 'success' AND model_name = 'anomaly_detector_shadow' THEN 'shadow'
       ELSE outcome END AS status,
  NOT swapped AND model_name = 'anomaly_detector_shadow' AS shadow,
  CASE WHEN swapped THEN model_name END AS fallback_for, CASE WHEN swapped THEN outcome END AS primary_status
FROM (SELECT *, model_name = 'anomaly_detector' AND outcome <> 'success' AS swapped FROM outcomes)"""

STEPS["rules"] = """
SELECT *,
  CASE WHEN coalesce(spo2_min_5m, spo2) < 92
    THEN {'name': 'low_spo2', 'severity': CASE WHEN coalesce(spo2_min_5m, spo2) < 88 THEN 'CRITICAL' ELSE 'HIGH' END,
          'reason': 'SpO2 ' || coalesce(spo2_min_5m, spo2) || ' below 92', 'score': 0.9::DOUBLE} END AS r1,
  CASE WHEN heart_rate >= 120
    THEN {'name': 'tachycardia', 'severity': CASE WHEN heart_rate >= 140 THEN 'HIGH' ELSE 'MEDIUM' END,
          'reason': 'heart_rate ' || heart_rate || ' >= 120', 'score': 0.7::DOUBLE} END AS r2,
  CASE WHEN respiratory_rate >= 26
    THEN {'name': 'high_respiratory_rate', 'severity': 'HIGH',
          'reason': 'respiratory_rate ' || respiratory_rate || ' >= 26', 'score': 0.75::DOUBLE} END AS r3,
  CASE WHEN occupancy_ratio >= 0.8
    THEN {'name': 'resource_congestion', 'severity': CASE WHEN occupancy_ratio >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END,
          'reason': 'occupancy ' || printf('%.2f', occupancy_ratio),
          'score': CASE WHEN occupancy_ratio >= 0.9 THEN 0.8::DOUBLE ELSE 0.55::DOUBLE END} END AS r4,
  CASE WHEN waiting_minutes >= 90
    THEN {'name': 'imaging_backlog', 'severity': 'HIGH', 'reason': 'imaging wait ' || waiting_minutes || 'm',
          'score': 0.7::DOUBLE} END AS r5,
  CASE WHEN missing_ratio >= 0.66
         OR (quality >= 0.4 AND event_type IN ('patient_vital', 'device_reading', 'bed_status', 'lab_result'))
    THEN {'name': 'data_quality_issue', 'severity': 'LOW',
          'reason': CASE WHEN missing_ratio >= 0.66 THEN 'high missingness' ELSE 'model flagged data quality' END,
          'score': 0.4::DOUBLE} END AS r6,
  CASE WHEN event_type = 'appointment_event'
    THEN {'name': 'model_confidence_low', 'severity': 'LOW', 'reason': 'no successful primary predictions',
          'score': 0.3::DOUBLE} END AS r7
FROM scores"""

STEPS["fired"] = """
SELECT *, list_transform(hit, lambda x: x.name) AS names, list_transform(hit, lambda x: x.reason) AS reasons,
  coalesce(list_max(list_transform(hit, lambda x: x.score)), 0.0::DOUBLE) AS rule_score,
  coalesce(list_max(list_transform(hit, lambda x:
    CASE x.severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END)), 1) AS level
FROM (SELECT *, list_filter([r1, r2, r3, r4, r5, r6, r7], lambda x: x IS NOT NULL) AS hit FROM rules)"""

STEPS["weighed"] = """
SELECT *,
  CASE event_type WHEN 'bed_status' THEN capacity_score * 0.7::DOUBLE + rule_score * 0.3::DOUBLE
    WHEN 'imaging_request' THEN imaging * 0.7::DOUBLE + rule_score * 0.3::DOUBLE
    ELSE (CASE WHEN event_type = 'patient_vital' THEN anomaly ELSE 0.0::DOUBLE END) * 0.45::DOUBLE
       + (CASE WHEN event_type IN ('patient_vital', 'lab_result') THEN risk ELSE 0.0::DOUBLE END) * 0.3::DOUBLE
       + rule_score * 0.25::DOUBLE END AS score,
  CASE event_type WHEN 'patient_vital' THEN (anomaly_confidence + risk_confidence + 0.9::DOUBLE) / 3
    WHEN 'lab_result' THEN (risk_confidence + 0.9::DOUBLE) / 2 WHEN 'bed_status' THEN (0.8::DOUBLE + 0.9::DOUBLE) / 2
    WHEN 'device_reading' THEN 0.9::DOUBLE WHEN 'imaging_request' THEN 0.75::DOUBLE
    WHEN 'resource_update' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS raw_confidence
FROM fired"""

STEPS["leveled"] = """
SELECT *, CASE WHEN score >= 0.85 AND level < 3 THEN 3 WHEN score >= 0.65 AND score < 0.85 AND level = 1 THEN 2
               ELSE level END AS final_level
FROM weighed"""

STEPS["decided"] = f"""
SELECT *, {round_even("score", 4)} AS decision_score, {round_even("raw_confidence", 4)} AS confidence,
  CASE WHEN list_contains(names, 'resource_congestion') THEN 'RESOURCE_CONGESTION'
    WHEN list_contains(names, 'data_quality_issue') AND severity = 'LOW' THEN 'DATA_QUALITY_ISSUE'
    WHEN list_contains(names, 'model_confidence_low') AND len(names) = 1 THEN 'MODEL_CONFIDENCE_LOW'
    WHEN list_contains(names, 'imaging_backlog') THEN 'REVIEW_RECOMMENDED'
    WHEN severity = 'MEDIUM' THEN 'ANOMALY_DETECTED' WHEN severity = 'LOW' THEN 'MONITOR'
    ELSE 'REVIEW_RECOMMENDED' END AS action,
  sha256('decision|' || event_id) AS id
FROM (SELECT *, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][final_level] AS severity FROM leveled)"""

STEPS["candidates"] = "SELECT * FROM decided WHERE NOT (action = 'MONITOR' AND severity = 'LOW')"

STEPS["alerts"] = """
SELECT *, sha256('alert|' || dedup_key) AS alert_id,
  action || ' (' || severity || ') for ' || coalesce(patient_id, 'resource') || ' — score='
    || printf('%.2f', decision_score) || ', rules=['
    || CASE WHEN len(names) > 0 THEN array_to_string(names, ', ') ELSE 'model scores' END
    || ']. Synthetic data; not a clinical diagnosis.' AS message
FROM (SELECT *, coalesce(patient_id, resource_id, source_id) || ':' || action || ':' || (arrival_us // 300000000) AS dedup_key
      FROM candidates)
QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY arrival_us, event_id) = 1"""

STEPS["commands"] = """
SELECT a.alert_id, a.event_id, c.command, c.actor, a.arrival_us + c.after_s * 1000000::BIGINT AS at_us,
  a.alert_id || '-' || c.step AS command_id
FROM alerts a JOIN (VALUES (2, 'ack', 'ana', 60), (4, 'ack', 'ben', 30), (3, 'resolve', 'ana', 120),
  (9, 'resolve', 'cho', 600), (5, 'ack', 'dee', 300)) c(step, command, actor, after_s) ON a.n % c.step = 0"""

# The lifecycle step by step: a command sees whether a resolve came before it, and which ack was the first.
STEPS["lifecycle"] = """
SELECT a.*, CASE WHEN r.resolved_us IS NOT NULL THEN 'RESOLVED' WHEN k.at_us IS NOT NULL THEN 'ACKNOWLEDGED'
               ELSE 'OPEN' END AS status,
  k.at_us AS acknowledged_us, k.actor AS acknowledged_by, r.resolved_us
FROM alerts a
LEFT JOIN (
  SELECT * FROM commands c WHERE command = 'ack' AND NOT EXISTS (
    SELECT 1 FROM commands r WHERE r.alert_id = c.alert_id AND r.command = 'resolve' AND r.at_us < c.at_us)
  QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY at_us, command_id) = 1) k ON k.alert_id = a.alert_id
LEFT JOIN (SELECT alert_id, max(at_us) AS resolved_us FROM commands WHERE command = 'resolve' GROUP BY 1) r
  ON r.alert_id = a.alert_id"""

STEPS["patients"] = """
SELECT 'pat_' || c_custkey AS external_ref, c_name AS display_name, 'ward_' || (c_nationkey % 12) AS ward_id FROM customer"""

NEEDS = {
    "typed": (),
    "wire": ("typed",),
    "judged": ("wire",),
    "checked": ("judged",),
    "accepted": ("checked",),
    "hist": ("accepted",),
    "put_off": ("accepted",),
    "hist_arrived": ("put_off",),
    "feat": ("hist",),
    "model_scores": ("feat",),
    "scores": ("model_scores",),
    "routed": ("scores",),
    "answers": ("routed",),
    "outcomes": ("answers",),
    "preds": ("outcomes",),
    "rules": ("scores",),
    "fired": ("rules",),
    "weighed": ("fired",),
    "leveled": ("weighed",),
    "decided": ("leveled",),
    "candidates": ("decided",),
    "alerts": ("candidates",),
    "commands": ("alerts",),
    "lifecycle": ("commands",),
    "patients": (),
}


def sql(select: str, *steps: str) -> str:
    """``select`` with the named steps and everything they build on."""
    ordered: list[str] = []

    def add(step: str) -> None:
        for parent in NEEDS[step]:
            add(parent)
        if step not in ordered:
            ordered.append(step)

    for step in steps:
        add(step)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{s} AS ({STEPS[s].strip()})" for s in ordered) + "\n" + select


def breaker_steps(calls: str, prefix: str, threshold: int = 5, reset_us: int = 15_000_000) -> str:
    """Steps ``{prefix}met``: every call of the step ``calls`` with its breaker, by jumping from one opening to the next.

    After an opening the next call let through is the first at or after the reset. If it fails, it is the next opening;
    else the next opening is the first call that ends a run of ``threshold`` failures which begins after it.
    """
    return f"""{prefix}calls AS (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY called_us, event_id) AS i FROM {calls}),
{prefix}ends AS (
  SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY model_name ORDER BY i
      ROWS BETWEEN {threshold - 1} PRECEDING AND CURRENT ROW) = {threshold} AS ends_run,
    coalesce(max(CASE WHEN ok THEN i END) OVER (PARTITION BY model_name ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_ok,
    min(i) OVER (PARTITION BY model_name ORDER BY called_us
      RANGE BETWEEN {reset_us} FOLLOWING AND UNBOUNDED FOLLOWING) AS trial
  FROM {prefix}calls),
{prefix}after AS (
  SELECT *, min(CASE WHEN ends_run THEN i END) OVER (PARTITION BY model_name ORDER BY i
      ROWS BETWEEN {threshold} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_full FROM {prefix}ends),
{prefix}jumps AS (
  SELECT a.model_name, a.i, a.trial, CASE WHEN t.ok THEN t.next_full ELSE t.i END AS next_open
  FROM {prefix}after a LEFT JOIN {prefix}after t ON t.model_name = a.model_name AND t.i = a.trial WHERE NOT a.ok),
{prefix}opens AS (
  SELECT j.* FROM {prefix}jumps j JOIN (SELECT model_name, min(i) AS i FROM {prefix}after WHERE ends_run GROUP BY 1) f
    ON f.model_name = j.model_name AND f.i = j.i
  UNION ALL
  SELECT j.* FROM {prefix}opens o JOIN {prefix}jumps j ON j.model_name = o.model_name AND j.i = o.next_open),
{prefix}met AS (
  SELECT c.* EXCLUDE (ends_run, last_ok, trial, next_full),
    CASE WHEN o.i IS NULL OR c.i > o.trial THEN 'CLOSED' WHEN c.i = o.trial THEN 'HALF_OPEN' ELSE 'OPEN' END AS breaker,
    CASE WHEN o.i IS NULL OR c.i > o.trial THEN c.i - 1 - c.last_ok ELSE {threshold} END::INT AS breaker_failures
  FROM {prefix}after c ASOF LEFT JOIN {prefix}opens o ON o.model_name = c.model_name AND o.i < c.i)"""
