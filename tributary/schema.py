"""Event envelope, payload fields and stage names as data.

The payload table drives both the validator and the typed views: adding a field
or an event type here needs no change elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    """One payload field: ``kind`` is float, int, text, choice or bool."""

    name: str
    kind: str
    required: bool = False
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    default: object = None

    @property
    def spark_type(self) -> str:
        return {"float": "double", "int": "bigint", "bool": "boolean"}.get(self.kind, "string")


# Event types, their payload fields, bounds, choices and defaults.
PAYLOADS: dict[str, tuple[Field, ...]] = {
    "patient_vital": (
        Field("heart_rate", "float", nullable=True, low=0, high=300),
        Field("spo2", "float", nullable=True, low=0, high=100),
        Field("respiratory_rate", "float", nullable=True, low=0, high=80),
        Field("temperature_c", "float", nullable=True, low=30, high=45),
        Field("systolic_bp", "float", nullable=True, low=40, high=300),
        Field("diastolic_bp", "float", nullable=True, low=20, high=200),
    ),
    "device_reading": (
        Field("metric", "text", required=True),
        Field("value", "float", required=True),
        Field("unit", "text", nullable=True),
        Field("quality", "choice", choices=("good", "poor", "unknown"), default="good"),
    ),
    "bed_status": (
        Field("ward_id", "text", required=True),
        Field("bed_id", "text", required=True),
        Field("status", "choice", required=True, choices=("available", "occupied", "cleaning", "blocked")),
        Field("occupancy_ratio", "float", nullable=True, low=0, high=1),
    ),
    "imaging_request": (
        Field("modality", "choice", required=True, choices=("CT", "MRI", "XRAY", "US", "PET")),
        Field("body_part", "text", required=True),
        Field("waiting_minutes", "int", required=True, low=0, high=10_000),
        Field("acuity_hint", "choice", nullable=True, choices=("low", "medium", "high")),
    ),
    "lab_result": (
        Field("test_code", "text", required=True),
        Field("value", "float", required=True),
        Field("unit", "text", required=True),
        Field("abnormal_flag", "bool", default=False),
    ),
    "resource_update": (
        Field("resource_type", "choice", required=True, choices=("staff", "room", "equipment")),
        Field("resource_id", "text", required=True),
        Field("available", "int", required=True, low=0),
        Field("capacity", "int", required=True, low=0),
    ),
    "appointment_event": (
        Field("appointment_id", "text", required=True),
        Field(
            "status",
            "choice",
            required=True,
            choices=("scheduled", "arrived", "in_progress", "completed", "no_show"),
        ),
        Field("department", "text", required=True),
        Field("wait_minutes", "int", low=0, default=0),
    ),
}

# Fixed values: (min, max) length of the envelope ids, and the longest entity id a stored event may carry.
ID_LENGTHS = {"event_id": (3, 64), "source_id": (1, 100), "trace_id": (8, 64)}
MAX_ENTITY_ID = 100
SCHEMA_VERSIONS = (1, 2)
NEEDS_PATIENT = ("patient_vital", "device_reading", "lab_result")
NEEDS_DEVICE = ("device_reading",)

# Stage names on the wire.
STAGES = {
    "raw": "healthcare.events.raw",
    "validated": "healthcare.events.validated",
    "features": "healthcare.features.ready",
    "predictions": "healthcare.predictions",
    "decisions": "healthcare.decisions",
    "alerts": "healthcare.alerts",
    "audit": "healthcare.audit",
    "quarantine": "healthcare.events.dlq",
}

# Envelope as it is read from JSON: variants keep "80" and 80 apart, so types can be checked.
WIRE_SCHEMA = (
    "event_id variant, source_id variant, event_type variant, patient_id variant, device_id variant, "
    "resource_id variant, timestamp variant, schema_version variant, trace_id variant, "
    "payload map<string, variant>"
)

EVENT_COLUMNS = (
    "event_id",
    "source_id",
    "event_type",
    "patient_id",
    "device_id",
    "resource_id",
    "event_time",
    "arrival_time",
    "schema_version",
    "trace_id",
    "attributes",
    "value",
)
