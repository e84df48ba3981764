"""Limits and windows shared by the batch and the streaming operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Limits that decide which events pass and how long state lives.
    allowed_skew_s: int = 300
    max_age_s: int = 86_400
    lateness_s: int = 120
    idempotency_s: int = 86_400
    alert_bucket_s: int = 300
    feature_ttl_s: int = 120
    requests_per_minute: int = 120
    breaker_threshold: int = 5
    breaker_reset_s: int = 15
    window_ms: int = 300_000

    # Width of the time slices that spread one entity's history over tasks; None = a rule on window_ms.
    slice_ms: int | None = None

    # History holds only what had arrived when its event did, so batch and stream agree on any order of time.
    as_of_arrival: bool = False


DEFAULTS = Settings()
