"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stage tables are timed as queries of their own (stage_*), from the raw tables on; the queries after
them read the stage tables. Each query is run once to the end through a sink that takes every column.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("TRIBUTARY_DRIVER_MEMORY", "16g")

from tributary.plans import flow  # noqa: E402
from tributary.plans.queries import QUERIES  # noqa: E402
from tributary.session import local_session, shared_folder  # noqa: E402

HEADLINE = [
    "dedup_events",
    "split_valid_quarantine",
    "feature_vector",
    "resolve_fallback",
    "decide",
    "alert_rows",
    "alert_lifecycle",
    "audit_trail",
    "event_summary",
    "patient_timeline",
    "overview",
    "model_stats",
    "breaker_state",
    "counter_rate",
    "latency_histogram",
    "histogram_quantile",
    "quota_flag",
    "train_risk_model",
    "score_isolation_forest",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def stream_latencies(spark, sf_dir: str) -> list[float]:
    """Durations (ms) of the micro-batches over the raw messages in eight files, with the five-minute window."""
    from tributary.settings import DEFAULTS
    from tributary.sources.tables import wire_events
    from tributary.streaming.stages import run_events

    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-stream"
    wire_events(spark, sf_dir).repartitionByRange(8, "arrival_time").write.parquet(f"{folder}/raw")
    raw = (
        spark.readStream.schema("value string, arrival_time timestamp")
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/raw")
    )
    query = run_events(raw, f"{folder}/out", f"{folder}/checkpoint", flow.fixed_scorers(), DEFAULTS, flow.with_fixed_raw)
    query.awaitTermination()
    return [float(p["durationMs"]["triggerExecution"]) for p in query.recentProgress if p["numInputRows"] > 0]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), name="bench")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for stage in ("accepted", "vectors", "predictions", "decisions"):
        times[f"stage_{stage}"] = timed(lambda: getattr(flow, stage)(spark, sf_dir))
    for name in sys.argv[1:] or HEADLINE:
        times[name] = timed(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    extra = {}
    if not sys.argv[1:]:
        batches = sorted(stream_latencies(spark, sf_dir))
        if batches:
            extra["stream_batch_ms_p50"] = statistics.median(batches)
            extra["stream_batch_ms_p95"] = batches[int(0.95 * (len(batches) - 1))]
            extra["stream_rows_per_sec"] = round(rows / (sum(batches) / 1000.0))
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "raw_events": rows,
                "rows_per_sec": {name: round(rows / max(sec, 1e-3)) for name, sec in times.items()},
                **extra,
            }
        )
    )


if __name__ == "__main__":
    main()
