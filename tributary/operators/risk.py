"""Risk model: labels from vital limits and a logistic regression fitted by Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.scoring import RISK_INPUTS, RiskModel, model_inputs

# Vital limits of the positive label, and the most iterations of the fit.
LABEL_LIMITS = {"heart_rate": 115.0, "spo2": 93.0, "respiratory_rate": 25.0}
LABEL_LIMITS_OFFLINE = {"heart_rate": 110.0, "spo2": 93.0, "respiratory_rate": 26.0}
MAX_ITERATIONS = 400


def risk_label(limits: dict[str, float] = LABEL_LIMITS) -> Column:
    hr, spo2, rr = (F.col(f"x{i}") for i in range(3))
    return (
        (hr > limits["heart_rate"]) | (spo2 < limits["spo2"]) | (rr > limits["respiratory_rate"])
    ).cast("double")


def training_rows(vectors: DataFrame, limits: dict[str, float] = LABEL_LIMITS) -> DataFrame:
    names = [f"x{i}" for i in range(len(RISK_INPUTS))]
    inputs = vectors.select(*[c.alias(n) for c, n in zip(model_inputs(RISK_INPUTS), names)])
    return VectorAssembler(inputCols=names, outputCol="inputs").transform(
        inputs.withColumn("label", risk_label(limits))
    )


def train_risk_model(vectors: DataFrame, limits: dict[str, float] = LABEL_LIMITS) -> RiskModel:
    """Fit on all rows; an L2 penalty of 1/n corresponds to the usual unit inverse strength."""
    rows = training_rows(vectors, limits).select("inputs", "label")
    n = rows.count()
    fit = LogisticRegression(
        featuresCol="inputs",
        labelCol="label",
        regParam=1.0 / max(n, 1),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MAX_ITERATIONS,
    ).fit(rows)
    return RiskModel(float(fit.intercept), tuple(float(w) for w in fit.coefficients))
