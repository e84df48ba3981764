"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's features are its distinct words (runs of letters and digits, lower case) and their first 4, 5 and 6 characters, hashed
into 2**20 places. The model has one weight per kept feature and K - 1 ordered thresholds that share them:
P(grade > k) = sigmoid(w.x - t_k). Its output is the expected severity, the sum of these probabilities over k.

The labels say toxic or not. Grades are made from them: 0 for clean, and toxic documents are grade 1 or 2 by whether they
hold fewer telling features than the median toxic document. Features are kept when their share among toxic training documents
exceeds that among clean ones by Z standard errors. The severity from which a document is rejected is the middle of the range that
gives the best F1 on documents held out of the fit.

The fit sees a sample of labelled documents drawn by hash, about ``max_labelled`` (12,000) however many there are; their texts are
kept once, features are counted by Spark, and only the kept features of the sample come to the driver. Scoring covers every
document, row by row, with the model broadcast (at most MAX_FEATURES weights).

Null and empty texts have no features. Labels that are null or belong to no document are ignored; the largest of repeated labels
counts. Without a toxic or without a clean labelled document every severity is 0 and none is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import documents_of, pieces, settled, texts_of

PLACES, PREFIXES, GRADES = 1 << 20, (4, 5, 6), 3
MAX_LABELLED, MAX_FEATURES, Z, LEAST = 12_000, 4096, 4.0, 2
CACHE = 200_000
words = re.compile(r"[^\W_]+").findall


def places(word: str) -> tuple[int, ...]:
    raw = word.encode()
    parts = [b"w" + raw, *(b"p" + word[:n].encode() for n in PREFIXES if len(word) >= n)]
    return tuple({zlib.crc32(p) % PLACES for p in parts})


def features(text: str) -> set[int]:
    return {p for w in set(words(text.lower())) for p in places(w)}


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: tuple[float, ...]
    cut: float
    held_out: dict[str, float]

    def severity(self, total: np.ndarray) -> np.ndarray:
        if not self.thresholds:
            return np.zeros(len(total))
        return sum(1 / (1 + np.exp(np.clip(t - total, -50, 50))) for t in self.thresholds)

    def grade(self, total: np.ndarray) -> np.ndarray:
        """The most probable grade."""
        over = [np.ones(len(total)), *(1 / (1 + np.exp(np.clip(t - total, -50, 50))) for t in self.thresholds), np.zeros(len(total))]
        return np.argmax([a - b for a, b in zip(over, over[1:])], axis=0)


class Scorer:
    """Sums of weights; the weights of a word's places are looked up once per word."""

    def __init__(self, model: Model):
        self.weights, self.known = model.weights, {}

    def total(self, text: str) -> float:
        known, hits = self.known, set()
        if len(known) > CACHE:
            known.clear()
        for w in set(words(text.lower())):
            found = known.get(w)
            if found is None:
                found = known[w] = tuple(p for p in places(w) if p in self.weights)
            if found:
                hits.update(found)
        return sum(self.weights[p] for p in sorted(hits))


def fit_thresholds(x: list[np.ndarray], y: np.ndarray, n: int, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model by Adam on the mean negative log likelihood."""
    row = np.repeat(np.arange(len(x)), [len(a) for a in x])
    col = np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
    k = GRADES - 1
    theta = np.concatenate([np.zeros(n), [1.0], np.zeros(k - 1)])  # weights, first threshold, logs of the gaps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[n + 1 :])
        cuts = theta[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        total = np.bincount(row, theta[col], len(x))
        over = 1 / (1 + np.exp(np.clip(cuts[None] - total[:, None], -50, 50)))  # P(grade > j)
        full = np.hstack([np.ones((len(x), 1)), over, np.zeros((len(x), 1))])
        at = np.arange(len(x))
        chance = np.maximum(full[at, y] - full[at, y + 1], 1e-12)
        slope = full * (1 - full)
        by_total = (slope[at, y] - slope[at, y + 1]) / chance
        by_cut = np.zeros_like(over)
        some = y > 0
        by_cut[at[some], y[some] - 1] -= slope[at[some], y[some]] / chance[some]
        some = y < k
        by_cut[at[some], y[some]] += slope[at[some], y[some] + 1] / chance[some]
        gradient = np.zeros_like(theta)
        gradient[:n] = -np.bincount(col, by_total[row], n)[:n] / len(x) + l2 * theta[:n]
        cut_gradient = -by_cut.sum(0) / len(x)
        gradient[n] = cut_gradient.sum()
        gradient[n + 1 :] = [cut_gradient[j:].sum() * gaps[j - 1] for j in range(1, k)]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:n], theta[n] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n + 1 :]))])


def _best_cut(severity: np.ndarray, toxic: np.ndarray) -> tuple[float, dict[str, float]]:
    order = np.argsort(-severity, kind="stable")
    s, t = severity[order], toxic[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + max(1, toxic.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1  # a cut can't part equal severities
    best = int(np.argmax(f1))
    low = s[best + 1] if best + 1 < len(s) else 0.0
    return float((s[best] + low) / 2), {"f1": float(f1[best]), "precision": float(hits[best] / (best + 1)), "recall": float(hits[best] / max(1, toxic.sum()))}


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1e6 * min(1.0, max_labelled / max(1, n))))
    sample = documents_of(docs, doc_id, text).join(F.broadcast(drawn), "doc_id")  # about max_labelled rows at most
    sample = settled(sample.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0))
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("toxic", "held").count().collect()}
    pos, neg = sizes.get((1, False), 0), sizes.get((0, False), 0)
    empty = Model({}, (), float("inf"), {})
    if not pos or not neg:
        return empty

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, PLACES), np.int32)
        for batch in pieces(batches):
            for t, mark in zip(texts_of(batch), batch.column(2).to_pylist()):
                count[mark, list(features(t))] += 1
        some = np.flatnonzero(count.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[1, some], pa.int64()), pa.array(count[0, some], pa.int64())], ["place", "pos", "neg"])

    counts = sample.where("not held").select("doc_id", "text", "toxic").mapInArrow(counted, "place long, pos long, neg long")
    counts = counts.groupBy("place").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST)
    share = (F.col("pos") + F.col("neg") + 1) / (pos + neg + 2)
    z = (F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    kept = [r[0] for r in counts.withColumn("z", z).where(F.col("z") >= Z).orderBy(F.desc("z"), "place").limit(MAX_FEATURES).collect()]
    if not kept:
        return empty
    index = {p: i for i, p in enumerate(sorted(kept))}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [sorted(index[p] for p in features(t) if p in index) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "held", "x"])

    rows = sample.select("doc_id", "text", "toxic", "held").mapInArrow(found, "toxic int, held boolean, x array<int>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["x"]))  # the fit doesn't depend on the order of tasks
    train = [r for r in rows if not r["held"]]
    middle = np.median([len(r["x"]) for r in train if r["toxic"]])
    y = np.array([r["toxic"] * (1 + (len(r["x"]) >= middle)) for r in train])
    weights, thresholds = fit_thresholds([np.array(r["x"], np.int64) for r in train], y, len(index))
    model = Model({p: float(weights[i]) for p, i in index.items()}, tuple(map(float, thresholds)), float("inf"), {})
    judged = [r for r in rows if r["held"]]
    if not any(r["toxic"] for r in judged):
        judged = rows
    total = np.array([sum(weights[i] for i in r["x"]) for r in judged])
    nothing = float(model.severity(np.zeros(1))[0])  # of a document without a kept feature, which is never rejected
    cut, model.held_out = _best_cut(model.severity(total), np.array([r["toxic"] for r in judged]))
    model.cut = max(cut, nothing + 1e-9)
    return model


def severities(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, severity (0 to GRADES - 1), grade (the most probable), rejected."""
    source = documents_of(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in pieces(batches):
            total = np.array([scorer.total(t) for t in texts_of(batch)])
            severity = shared.value.severity(total)
            columns = [batch.column(0), pa.array(severity), pa.array(shared.value.grade(total), pa.int32()), pa.array(severity >= shared.value.cut)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "grade", "rejected"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, severity double, grade int, rejected boolean")


def accepted(text: Column, model: Model, spark) -> Column:
    """True where the model doesn't reject the text; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)
    held: dict[int, Scorer] = {}

    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        scorer = held.setdefault(0, Scorer(shared.value))
        total = np.array([scorer.total(t or "") for t in texts], np.float64)
        return pd.Series(shared.value.severity(total) < shared.value.cut)

    return judge(text)
