"""Stored releases: what is read back scores as what was trained, by a plain computation, and by the event's time."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators.alerts import open_alerts
from tributary.operators.forest import MAX_DEPTH, TREES, _grow, average_path, offset_shares, tree_rows, train_isolation_forest
from tributary.operators.models import model_list, predict_released, publish, releases, risk_gradient, stored_models, train_release
from tributary.operators.scoring import FOREST_INPUTS, RISK_INPUTS, RiskModel, model_inputs
from tributary.plans import flow
from tributary.plans.queries import QUERIES

EARLY, LATE = (datetime(2024, 1, day, tzinfo=timezone.utc) for day in (10, 20))
VERSIONS = {"anomaly_detector": "2.1", "anomaly_detector_shadow": "2.2-shadow", "risk_predictor": "1.4"}


@pytest.fixture(scope="module")
def trained(spark, sf, tmp_path_factory):
    folder, rows = str(tmp_path_factory.mktemp("models") / "store"), flow.vital_vectors(spark, sf)
    made = [
        train_release(rows.filter(F.col("event_time") < F.lit(LATE)), 1, EARLY, VERSIONS),
        train_release(rows, 2, LATE, {name: f"{v}.b" for name, v in VERSIONS.items()}),
    ]
    for release in made[::-1]:  # the order of writing does not matter
        publish(spark, folder, release)
    return folder, rows, made


def path_length(forest, root, x):
    """One row down one tree, node by node."""
    at = root
    while forest.feature[at] >= 0:
        at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
    return forest.depth[at]


def test_releases_come_back_as_they_were(spark, trained):
    folder, _, made = trained
    found = releases(spark, folder)
    assert [r.number for r in found] == [1, 2]
    for got, want in zip(found, made):
        assert (got.valid_from, got.versions, got.offsets, got.risk) == (want.valid_from, want.versions, want.offsets, want.risk)
        assert got.forest.sample == want.forest.sample
        for name in ("feature", "threshold", "left", "right", "depth", "roots"):
            assert np.array_equal(getattr(got.forest, name), getattr(want.forest, name)), name
    listed = model_list(stored_models(spark, folder)).collect()
    assert len(listed) == 6 and len({r.model_hash for r in listed}) == 6
    with pytest.raises(Exception, match="(?i)already exists"):
        publish(spark, folder, made[0])


def test_events_are_scored_by_the_release_of_their_time(spark, sf, trained):
    folder, rows, _ = trained
    known = releases(spark, folder)
    inputs = rows.select(
        "event_id",
        "event_time",
        F.array(*model_inputs(FOREST_INPUTS)).alias("forest"),
        F.array(*model_inputs(RISK_INPUTS)).alias("risk"),
    ).collect()
    scored = predict_released(flow.vectors(spark, sf), known)
    assert scored.count() == flow.vectors(spark, sf).count()
    got = {r.event_id: {p.model_name: p for p in r.predictions} for r in scored.filter("event_type = 'patient_vital'").collect()}
    spans = set()
    for row in inputs:
        time, answers = row.event_time.replace(tzinfo=timezone.utc), got[row.event_id]
        release = known[1] if time >= LATE else known[0] if time >= EARLY else None
        spans.add(release and release.number)
        if release is None:
            assert answers["threshold_detector"].fallback_for == "anomaly_detector"
            assert answers["risk_predictor"].status == answers["anomaly_detector_shadow"].status == "circuit_open"
            continue
        z = release.risk.intercept + np.dot(release.risk.weights, row.risk)
        assert answers["risk_predictor"].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        forest = release.forest
        mean = np.mean([path_length(forest, root, row.forest) for root in forest.roots])
        raw = 2.0 ** (-mean / average_path(forest.sample))
        for name, offset in release.offsets.items():
            want = 1 / (1 + np.exp(-4 * (raw + offset - 0.05)))
            assert answers[name].score == pytest.approx(want, abs=1e-9)
            assert answers[name].model_version == release.versions[name]
    assert spans == {None, 1, 2}


def test_without_releases_nothing_trained_answers(spark, sf):
    rows = predict_released(flow.vital_vectors(spark, sf), []).select(F.explode("predictions").alias("p")).select("p.*")
    assert {r.status for r in rows.filter("model_name = 'risk_predictor'").select("status").distinct().collect()} == {"circuit_open"}


def test_checks_tell_good_models_from_bad(spark, trained):
    folder, rows, _ = trained
    release = releases(spark, folder)[1]
    bad = RiskModel(release.risk.intercept + 0.5, release.risk.weights)
    size = lambda model: max(abs(r.gradient) / r["size"] for r in risk_gradient(rows, model).collect())
    assert size(release.risk) < 1e-4 < size(bad)
    n = rows.count()
    for r in offset_shares(rows, release.forest, release.offsets).collect():
        share = {"anomaly_detector": 0.03, "anomaly_detector_shadow": 0.08}[r.model_name]
        assert r.rows == n and r.below <= share * (n - 1) + 1 and r.at_or_below > int(share * (n - 1))
    nodes = train_isolation_forest(rows, n)
    assert [tuple(r) for r in tree_rows(nodes).orderBy("tree").collect()] == [(t, min(n, 256), min(n, 256), True) for t in range(TREES)]
    assert nodes.filter((F.col("feature") < 0) & (F.col("depth") > MAX_DEPTH + average_path(256))).count() == 0
    broken = nodes.withColumn("rows", F.when((F.col("tree") == 3) & (F.col("node") == 1), 0).otherwise(F.col("rows")))
    assert [r.tree for r in tree_rows(broken).filter("not whole").collect()] == [3]


def test_alerts_of_trained_models(spark, sf):
    """The registered query is the alert operator on the decisions of stored models, one alert per key."""
    decided = flow.trained_decisions(spark, sf)
    got = {r.id: r.dedup_key for r in QUERIES["trained_alerts"](spark, sf).collect()}
    assert got == {r.id: r.dedup_key for r in open_alerts(decided).collect()}
    assert got and len(set(got.values())) == len(got)


def test_a_split_between_neighbouring_doubles_leaves_rows_on_both_sides():
    low = 1.0 + 2.0**-52
    rows = np.array([[low], [np.nextafter(low, 2.0)], [low]])
    for seed in range(100):
        nodes = _grow(rows, np.random.default_rng(seed))
        assert nodes[0][0] == 0 and sorted(n[5] for n in nodes) == [1, 2, 3]
