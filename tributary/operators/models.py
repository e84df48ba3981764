"""Trained models as a stored table of releases, and scoring by the release valid at an event's time.

A release is one training's outcome: the forest's nodes, an offset per forest model, the risk model's coefficients, the
versions they go by and the time from which they are valid. It is written once under its number and never changed, so a
replay of old events finds the models that were valid then. Its size is bounded by the forest (60 x 511 nodes), not by data.

An event before the first release has no trained model: those count as unreachable, and fallbacks answer.
Releases that begin at one time follow each other by number; the last one counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.forest import CONTAMINATION, Forest, fit_forest, forest_offsets, with_forest_raw
from tributary.operators.registry import REGISTRY, Registry, model_hash
from tributary.operators.risk import LABEL_LIMITS, train_risk_model, training_rows
from tributary.operators.scoring import RISK_INPUTS, RiskModel, forest_column, predict, scorers

RISK = "risk_predictor"
# kind: node (of the release's forest), sample (rows of a tree), offset, intercept, weight (item: input) or version (text).
_ROWS = (
    "model_name string, kind string, item int, tree int, feature int, threshold double, "
    "`left` int, `right` int, value double, text string, valid_from timestamp"
)


@dataclass(frozen=True)
class Release:
    number: int
    valid_from: datetime
    versions: dict[str, str]
    forest: Forest
    offsets: dict[str, float]
    risk: RiskModel

    def registry(self, registry: Registry = REGISTRY) -> Registry:
        models = tuple(replace(m, version=self.versions.get(m.name, m.version)) for m in registry.models)
        return replace(registry, models=models)


def train_release(vitals: DataFrame, number: int, valid_from: datetime, versions: dict[str, str]) -> Release:
    """All trained models from one table of vital vectors."""
    forest = fit_forest(vitals)
    return Release(number, valid_from, versions, forest, forest_offsets(vitals, forest, CONTAMINATION), train_risk_model(vitals))


def publish(spark: SparkSession, folder: str, release: Release) -> None:
    """Write a release; a number that is there already is an error."""
    at, forest = release.valid_from, release.forest
    tree = np.searchsorted(forest.roots, np.arange(len(forest.feature)), side="right") - 1
    arrays = (tree, forest.feature, forest.threshold, forest.left, forest.right, forest.depth)
    rows = [(None, "node", i, *node, None, at) for i, node in enumerate(zip(*(a.tolist() for a in arrays)))]
    one = lambda name, kind, item, value, text=None: (name, kind, item, None, None, None, None, None, value, text, at)
    rows += [one(None, "sample", 0, float(forest.sample))]
    rows += [one(name, "offset", 0, float(value)) for name, value in release.offsets.items()]
    rows += [one(RISK, "intercept", 0, release.risk.intercept)]
    rows += [one(RISK, "weight", i, value) for i, value in enumerate(release.risk.weights)]
    rows += [one(name, "version", 0, None, text) for name, text in release.versions.items()]
    stored = spark.createDataFrame(rows, _ROWS).coalesce(1)
    stored.write.mode("errorifexists").parquet(f"{folder}/release={release.number}")


def stored_models(spark: SparkSession, folder: str) -> DataFrame:
    """The table: one row per node, offset, coefficient and version of every release."""
    return spark.read.schema(f"{_ROWS}, release int").parquet(folder)


def model_list(stored: DataFrame) -> DataFrame:
    """Release, model, version, hash and the time it holds from."""
    return stored.filter("kind = 'version'").select(
        "release", "valid_from", "model_name", F.col("text").alias("model_version"),
        model_hash(F.col("model_name"), F.col("text")).alias("model_hash"),
    )


def releases(spark: SparkSession, folder: str) -> list[Release]:
    """All releases in the order they become valid; as many rows on the driver as the models have parts."""
    frame = stored_models(spark, folder).withColumn("valid_us", F.unix_micros("valid_from")).drop("valid_from").toPandas()
    found = []
    for number, part in frame.groupby("release"):
        of = lambda kind: part[part["kind"] == kind].sort_values("item")  # noqa: E731,B023
        nodes = of("node")
        ints = lambda name: nodes[name].to_numpy().astype(np.int64)  # noqa: E731,B023
        tree = ints("tree")
        forest = Forest(
            ints("feature"),
            nodes["threshold"].to_numpy(),
            ints("left"),
            ints("right"),
            nodes["value"].to_numpy(),
            np.flatnonzero(np.diff(tree, prepend=-1)),
            int(of("sample")["value"].iat[0]),
        )
        version, offset = of("version"), of("offset")
        found.append(
            Release(
                int(number),
                datetime.fromtimestamp(part["valid_us"].iat[0] / 1e6, timezone.utc),
                dict(zip(version["model_name"], version["text"])),
                forest,
                dict(zip(offset["model_name"], map(float, offset["value"]))),
                RiskModel(float(of("intercept")["value"].iat[0]), tuple(map(float, of("weight")["value"]))),
            )
        )
    return sorted(found, key=lambda r: (r.valid_from, r.number))


def predict_released(vectors: DataFrame, known: list[Release], registry: Registry = REGISTRY) -> DataFrame:
    """``predict`` with, per event, the models valid at its time.

    The vectors are read once per release, each time cut to its span of time, a filter that reaches the stored table.
    """
    at = F.col("event_time")
    starts = [F.lit(r.valid_from).cast("timestamp") for r in known]
    spans = [vectors.filter(at < starts[0]) if known else vectors]
    untrained = spans[0].withColumns({forest_column(n): F.lit(None).cast("double") for n in CONTAMINATION})
    out = predict(untrained, scorers(), registry)
    for i, release in enumerate(known):
        span = vectors.filter(at >= starts[i])
        if i + 1 < len(known):
            span = span.filter(at < starts[i + 1])
        raw = with_forest_raw(span, release.forest, release.offsets)
        out = out.unionByName(predict(raw, scorers(release.risk, tuple(release.offsets)), release.registry(registry)))
    return out


def risk_gradient(vectors: DataFrame, model: RiskModel, limits: dict[str, float] = LABEL_LIMITS) -> DataFrame:
    """Per input of the risk model the gradient of its penalised loss at its coefficients: nothing at the minimum.

    Columns: input, rows, positives, gradient, and size, the mean magnitude of the summands the gradient is the mean of.
    """
    names = ["intercept", *[name for name, _ in RISK_INPUTS]]
    weights = (model.intercept, *model.weights)
    values = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(RISK_INPUTS))]]
    z = sum((F.lit(w) * x for w, x in zip(weights[1:], values[1:])), F.lit(weights[0]))
    off = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col("label")
    sums = training_rows(vectors, limits).withColumn("_off", off).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label") == 1).alias("positives"),
        *[F.avg(F.col("_off") * x).alias(f"g{i}") for i, x in enumerate(values)],
        *[F.avg(F.abs(x)).alias(f"s{i}") for i, x in enumerate(values)],
    )
    # The intercept has no penalty; the others' is the sum of squares over twice the rows.
    entries = [
        F.struct(
            F.lit(name).alias("input"),
            (F.col(f"g{i}") + (F.lit(weights[i]) / F.col("rows") if i else F.lit(0.0))).alias("gradient"),
            F.col(f"s{i}").alias("size"),
        )
        for i, name in enumerate(names)
    ]
    return sums.select("rows", "positives", F.inline(F.array(*entries)))
