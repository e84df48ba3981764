"""Models, routing and weights as literals: a fixed, driver-side configuration.

The tables become literal expressions (maps and arrays) in the plans, so looking a model up costs
neither a join nor a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    name: str
    version: str
    timeout_ms: int = 200
    enabled: bool = True
    fallback: str | None = None
    shadow: bool = False


# Models with version, time limit (ms), fallback and shadow mark.
MODELS = (
    Model("anomaly_detector", "2.1", 150, fallback="threshold_detector"),
    Model("threshold_detector", "1.0", 20),
    Model("risk_predictor", "1.4", 200),
    Model("capacity_forecaster", "1.0", 80),
    Model("imaging_prioritizer", "1.0", 60),
    Model("data_quality_scorer", "1.0", 40),
    Model("anomaly_detector_shadow", "2.2-shadow", 150, shadow=True),
)

# Models per event type in the order they are reported.
ROUTING = {
    "patient_vital": ("anomaly_detector", "risk_predictor", "data_quality_scorer", "anomaly_detector_shadow"),
    "device_reading": ("data_quality_scorer",),
    "bed_status": ("capacity_forecaster", "data_quality_scorer"),
    "imaging_request": ("imaging_prioritizer",),
    "lab_result": ("risk_predictor", "data_quality_scorer"),
    "resource_update": ("capacity_forecaster",),
    "appointment_event": (),
}

# Weights of the decision score, and the time limit of a fallback call.
WEIGHTS = {"anomaly_detector": 0.45, "risk_predictor": 0.30, "rules": 0.25}
FALLBACK_TIMEOUT_MS = 50


@dataclass(frozen=True)
class Registry:
    models: tuple[Model, ...] = MODELS
    routing: tuple[tuple[str, tuple[str, ...]], ...] = tuple(ROUTING.items())

    def find(self, name: str | None) -> Model | None:
        return next((m for m in self.models if m.name == name and m.enabled), None)

    def routed(self, event_type: str) -> list[Model]:
        """Enabled models of an event type in list order; unknown types have none."""
        names = dict(self.routing).get(event_type, ())
        return [m for m in map(self.find, names) if m is not None]

    def lookup(self, name: Column, attribute: str) -> Column:
        """A model attribute by model name as a literal map lookup."""
        pairs = [F.lit(x) for m in self.models for x in (m.name, getattr(m, attribute))]
        return F.try_element_at(F.create_map(*pairs), name)


REGISTRY = Registry()


def route_models(event_type: Column, registry: Registry = REGISTRY) -> Column:
    """Array of (position, model_name, model_version) for an event type."""
    empty = F.expr("cast(array() as array<struct<position:int,model_name:string,model_version:string>>)")
    routed = empty
    for kind, _ in registry.routing:
        entries = [
            F.struct(F.lit(i).alias("position"), F.lit(m.name).alias("model_name"), F.lit(m.version).alias("model_version"))
            for i, m in enumerate(registry.routed(kind))
        ]
        if entries:
            routed = F.when(event_type == kind, F.array(*entries)).otherwise(routed)
    return routed


def model_hash(name: Column, version: Column) -> Column:
    return F.substring(F.sha2(F.concat(name, F.lit(":"), version), 256), 1, 16)
