"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors are scaled to length 1 (double precision) and quantised: v = s * q + e with int8 q. For two vectors
cos = s_a s_b q_a.q_b + s_a q_a.e_b + e_a.v_b, so |cos - s_a s_b q_a.q_b| <= |s_a q_a| |e_b| + |e_a|: the quantised product and
each vector's |e| bound the cosine from both sides. Pairs surely above or surely below the threshold are settled by the
product of the tiles; only pairs that may lie on either side are computed again in double precision.

Only vectors of equal labels meet. A label with n vectors is dealt by hash into ceil(n / TILE) tiles, and each pair of tiles is a
group of its own, so a hot label is many groups of at most about two tiles. Equal vectors of a label are one
vector with a count. No pairs leave a group: it returns, per vector, how many vectors it links to, and a spanning forest.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link with nothing and are their
own component. Vectors of different lengths do not link. Rows of one id count as vectors of their own for links; their
components are by id. Null ids link like others and get the component of the vectors they equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import settled
from tributary.llm.components import components

TILE, STRIP, PAIRS = 4096, 256, 65_536
#: Room for rounding in the bounds, far above what 64-bit sums of a few thousand terms can lose.
ROUNDING = 1e-9


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, integers of at most 127 as float32, scale, length of the error) of the rows, none of them zero."""
    # Powers of two change no digit, and squares of the largest and smallest doubles then neither overflow nor vanish.
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127.0
    whole = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - whole * scale[:, None]) ** 2).sum(1))
    return unit, whole.astype(np.float32), scale, error


def links(mine: tuple, other: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into mine, into other) with cosine >= threshold; with ``same`` each pair once.

    Integers up to 127 in float32 products of up to 1,000 terms stay below 2**24, so they are exact; longer vectors are cut.
    """
    (a, qa, sa, ea), (b, qb, sb, eb) = mine, other
    lengths = np.sqrt((qa.astype(np.float64) ** 2).sum(1)) * sa
    for start in range(0, len(a), STRIP):
        rows = slice(start, start + STRIP)
        cuts = [slice(c, c + 1000) for c in range(0, qa.shape[1], 1000)]
        product = sum((qa[rows, c] @ qb[:, c].T).astype(np.float64) for c in cuts) * sa[rows, None] * sb
        bound = ea[rows, None] + lengths[rows, None] * eb + ROUNDING
        sure = product - bound >= threshold
        maybe = ~sure & (product + bound >= threshold)
        if same:
            later = np.arange(len(b)) > np.arange(start, min(start + STRIP, len(a)))[:, None]
            sure &= later
            maybe &= later
        i, j = np.nonzero(sure)
        if len(i):
            yield i + start, j
        i, j = np.nonzero(maybe)
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS] + start, j[k : k + PAIRS]
            real = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            if real.any():
                yield x[real], y[real]


class Forest:
    """Smallest index reachable by the links seen so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]


def near_copies(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE, vec_id: str = "vec_id",
                embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.transform(F.col(embedding).cast("array<double>"), lambda x: x + 0.0).alias("v"),  # -0.0 becomes 0.0
        F.col(label).alias("label"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    fit = F.col("v").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = settled(rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("key", F.when(F.col("fit"), F.xxhash64("label", "v"))))
    one = rows.where("fit").groupBy("label", "v").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    one = one.withColumn("dim", F.size("v"))
    tiles = one.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = one.join(tiles, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("key"), "tiles").cast("int"))
    dealt = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "dim", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "key", "n", "v")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iat[0], group["j"].iat[0]
        mine, other = group[group["t"] == i], group[group["t"] == j]
        keys = np.concatenate([mine["key"].to_numpy(), other["key"].to_numpy()] if i != j else [mine["key"].to_numpy()])
        if not len(mine) or not len(other):
            return pd.DataFrame({"key": [], "links": [], "root": []})
        count, forest = np.zeros(len(keys), np.int64), Forest(len(keys))
        first = quantised(np.stack(mine["v"].to_numpy()).astype(np.float64))
        second = first if i == j else quantised(np.stack(other["v"].to_numpy()).astype(np.float64))
        n, m = mine["n"].to_numpy(), other["n"].to_numpy()
        for x, y in links(first, second, threshold, i == j):
            z = y if i == j else y + len(mine)
            count += np.bincount(x, m[y], len(keys)).astype(np.int64) + np.bincount(z, n[x], len(keys)).astype(np.int64)
            forest.add(x, z)
        some = np.flatnonzero(count)
        return pd.DataFrame({"key": keys[some], "links": count[some], "root": keys[forest.root[some]]})

    found = settled(dealt.groupBy("label", "dim", "i", "j").applyInPandas(compare, "key long, links long, root long"))
    joined = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    one = one.select("key", "n", "first").join(counts, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    one = one.withColumn("root", F.coalesce("root", "key"))
    smallest = one.groupBy("root").agg(F.min("first").alias("component_id"))
    one = one.join(smallest, "root").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "key").join(one, "key", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
