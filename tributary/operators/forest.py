"""Isolation forest: trees grown one per group on hash-assigned samples, path lengths in Arrow batches.

Trees are small by construction (at most 256 rows each), so the whole forest has a fixed size bound:
trees x 511 nodes. Sampling is the algorithm itself; the offset is computed on all training rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.reports import quantile_by_position
from tributary.operators.scoring import FOREST_INPUTS, forest_column, model_inputs
from tributary.session import shared_folder

# Rows per tree, depth limit, trees, shares of outliers of the primary and the shadow model.
SAMPLE = 256
MAX_DEPTH = 8
TREES = 60
CONTAMINATION = {"anomaly_detector": 0.03, "anomaly_detector_shadow": 0.08}

_NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double, rows int"


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees as arrays, the sample size of a tree, and the score offset."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    sample: int
    offset: float = 0.0


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random splits until a row is alone or the depth limit is reached; nodes in pre-order."""
    nodes: list[list] = []
    todo = [(rows, 0, -1, False)]
    while todo:
        part, depth, parent, is_right = todo.pop()
        index = len(nodes)
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = index
        spread = part.max(axis=0) - part.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if depth >= MAX_DEPTH or len(part) <= 1 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + average_path(len(part)), len(part)])
            continue
        column = int(rng.choice(usable))
        low, high = part[:, column].min(), part[:, column].max()
        # Between neighbouring doubles the draw can round up to the highest value, which would leave nothing to the right.
        cut = float(min(rng.uniform(low, high), np.nextafter(high, low)))
        nodes.append([column, cut, -1, -1, 0.0, len(part)])
        goes_left = part[:, column] <= cut
        todo.append((part[~goes_left], depth + 1, index, True))
        todo.append((part[goes_left], depth + 1, index, False))
    return [tuple(n) for n in nodes]


def _input_columns() -> list[Column]:
    return [c.alias(f"x{i}") for i, c in enumerate(model_inputs(FOREST_INPUTS))]


def train_isolation_forest(
    vectors: DataFrame, rows: int, id_column: str = "event_id", trees: int = TREES, seed: int = 7
) -> DataFrame:
    """Nodes of ``trees`` trees as a DataFrame, each grown in its own group.

    A tree's sample is the 256 rows with the smallest hashes of row id and tree, out of all ``rows``. Each row names the trees
    whose bound its hash is below (a bound that about twice 256 rows per tree pass), so it is copied once per such
    tree, and every map task keeps its smallest 256 per tree before the shuffle.
    """
    if rows < 2:
        raise ValueError("a forest needs two rows at least")
    names = [f"x{i}" for i in range(len(FOREST_INPUTS))]
    share = min(1.0, 2.0 * SAMPLE / rows)
    trees_of = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.pmod(F.xxhash64(F.col("id"), t, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)),
    )
    all_rows = vectors.select(F.col(id_column).alias("id"), *_input_columns())
    spread = all_rows.withColumn("tree", F.explode(trees_of))
    order = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1 << 30))
    window = Window.partitionBy("tree").orderBy(order, "id")
    samples = spread.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= SAMPLE)

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        frame = frame.sort_values("_rank")
        nodes = _grow(frame[names].to_numpy(dtype=float), np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth", "rows"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(grow, _NODES)


def load_forest(nodes: DataFrame, rows: int) -> Forest:
    """Bring the trees to the driver: at most trees x 511 nodes, whatever the training data's size."""
    frame = nodes.orderBy("tree", "node").toPandas()
    starts = frame.groupby("tree", sort=True).size().cumsum().shift(fill_value=0).to_numpy()
    base = np.repeat(starts, frame.groupby("tree", sort=True).size().to_numpy())
    inner = frame["feature"].to_numpy() >= 0
    return Forest(
        frame["feature"].to_numpy(),
        frame["threshold"].to_numpy(),
        np.where(inner, frame["left"].to_numpy() + base, -1),
        np.where(inner, frame["right"].to_numpy() + base, -1),
        frame["depth"].to_numpy(),
        starts,
        min(SAMPLE, rows),
    )


def tree_rows(nodes: DataFrame) -> DataFrame:
    """Per tree the rows of its root and of its leaves together, and whether each inner node's children share out its rows."""
    child = nodes.select("tree", F.col("node").alias("child"), F.col("rows").alias("_rows"))
    inner = nodes.filter("feature >= 0").select("tree", "node", "rows", F.explode(F.array("left", "right")).alias("child"))
    split = inner.join(child, ["tree", "child"], "left").groupBy("tree", "node", "rows").agg(F.sum("_rows").alias("_both"))
    odd = split.filter(~F.col("rows").eqNullSafe(F.col("_both"))).groupBy("tree").agg(F.count("*").alias("_odd"))
    sums = nodes.groupBy("tree").agg(
        F.sum(F.when(F.col("node") == 0, F.col("rows"))).alias("root_rows"),
        F.sum(F.when(F.col("feature") < 0, F.col("rows"))).alias("leaf_rows"),
    )
    return sums.join(odd, "tree", "left").select("tree", "root_rows", "leaf_rows", F.col("_odd").isNull().alias("whole"))


def offset_shares(vectors: DataFrame, forest: Forest, offsets: dict[str, float]) -> DataFrame:
    """Per model the rows, those with a score below its offset, and those with one at it or below."""
    score = -F.col("_anomaly")
    counts = _with_anomaly(vectors, forest, "_anomaly").agg(
        F.count("*").alias("rows"),
        *[F.count_if(score < F.lit(o) - 1e-12).alias(f"_below{i}") for i, o in enumerate(offsets.values())],
        *[F.count_if(score <= F.lit(o) + 1e-12).alias(f"_upto{i}") for i, o in enumerate(offsets.values())],
    )
    entries = [
        F.struct(F.lit(name).alias("model_name"), F.col(f"_below{i}").alias("below"), F.col(f"_upto{i}").alias("at_or_below"))
        for i, name in enumerate(offsets)
    ]
    return counts.select("rows", F.inline(F.array(*entries)))


def anomaly_score(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2^(-mean path / expected path) for a batch of rows, all rows walking each tree together."""
    total = np.zeros(len(x))
    row = np.arange(len(x))
    for root in forest.roots:
        at = np.full(len(x), root)
        for _ in range(MAX_DEPTH):
            split = forest.feature[at]
            inner = split >= 0
            if not inner.any():
                break
            goes_left = x[row, np.where(inner, split, 0)] <= forest.threshold[at]
            at = np.where(inner, np.where(goes_left, forest.left[at], forest.right[at]), at)
        total += forest.depth[at]
    return 2.0 ** (-(total / len(forest.roots)) / average_path(forest.sample))


def _with_anomaly(vectors: DataFrame, forest: Forest, name: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shared.value
        for columns in batches:
            yield pd.Series(anomaly_score(trees, np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return vectors.withColumn(name, score(*model_inputs(FOREST_INPUTS)))


def forest_offsets(vectors: DataFrame, forest: Forest, shares: dict[str, float]) -> dict[str, float]:
    """Per model name the score below which its share of training rows falls: exact, linear between two rows.

    The scores are written once to the shared folder, so the trees are walked once for all quantiles.
    """
    spark = vectors.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-scores"
    _with_anomaly(vectors, forest, "_anomaly").select(
        F.lit(0).alias("one"), (-F.col("_anomaly")).alias("s")
    ).write.parquet(path)
    scores = spark.read.parquet(path)
    picks = [
        quantile_by_position(scores, ["one"], "s", share, widths=(1e-3, 1e-6), upper=upper).select(
            F.lit(name).alias("name"), F.lit(upper).alias("upper"), "s"
        )
        for name, share in shares.items()
        for upper in (False, True)
    ]
    found = {(r["name"], r["upper"]): r["s"] for r in reduce(DataFrame.unionByName, picks).collect()}
    last = scores.count() - 1
    offsets = {}
    for name, share in shares.items():
        low, high = found[name, False], found[name, True]
        offsets[name] = low + (high - low) * (share * last - int(share * last))
    return offsets


def fit_forest(vectors: DataFrame, trees: int = TREES, seed: int = 7) -> Forest:
    """Train and load; an action, as fitting is."""
    rows = vectors.count()
    return load_forest(train_isolation_forest(vectors, rows, trees=trees, seed=seed), rows)


def with_forest_raw(vectors: DataFrame, forest: Forest, offsets: dict[str, float]) -> DataFrame:
    """Negated decision function per model name, ready for ``scoring.score_isolation_forest``.

    The trees are walked once for all models that share the forest and differ in the offset only.
    """
    scored = _with_anomaly(vectors, forest, "_anomaly")
    raws = {forest_column(name): F.col("_anomaly") + F.lit(float(offset)) for name, offset in offsets.items()}
    return scored.withColumns(raws).drop("_anomaly")

