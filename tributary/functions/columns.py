"""Small column expressions used by several operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Hashable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build a column expression once per JVM and set of arguments; those of an earlier JVM are dropped.

    Expressions are immutable and refer to columns by name. Building a large one takes thousands of calls
    into the JVM, which would be the main cost of a small micro-batch.
    """
    known: dict[Hashable, Column] = {}
    owner = None

    @functools.wraps(build)
    def get(*args: Hashable) -> Column:
        nonlocal owner
        if owner is not SparkContext._gateway:
            known.clear()
            owner = SparkContext._gateway
        if args not in known:
            known[args] = build(*args)
        return known[args]

    return get


def first_non_blank(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def number(col: Column, default: float) -> Column:
    """A numeric input with a default for null (booleans: true is 1, false counts as missing)."""
    return F.coalesce(col.cast("double"), F.lit(float(default)))


def flag_number(col: Column, default: float = 0.0) -> Column:
    return F.when(col, F.lit(1.0)).otherwise(F.lit(float(default)))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def capped(score: Column) -> Column:
    return F.least(F.lit(1.0), score)


def round_even(x: Column, digits: int) -> Column:
    """Round the *binary* value of a double to ``digits`` decimals, ties to even.

    ``round`` and ``bround`` work on the shortest decimal text of the double, so 0.265 (stored as
    0.26500000000000001) is a tie for them. Here the exact error of ``x * 10^digits`` (Dekker's
    product) decides. Pass a column rather than a large expression: it is referenced several times.
    """
    scale = F.lit(float(10**digits))
    product = x * scale
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    error = (high * scale - product) + (x - high) * scale
    base = F.floor(product).cast("double")
    side = (product - base - F.lit(0.5)) + error
    up = (side > 0) | ((side == 0) & (F.pmod(base, F.lit(2.0)) == 1))
    return (base + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def stable_id(*parts: Column | str) -> Column:
    """Deterministic id from a natural key, so that re-runs and replays write the same ids."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)


def partition_key() -> Column:
    """The entity an event belongs to: patient, else resource, else source, else the event itself."""
    return first_non_blank(F.col("patient_id"), F.col("resource_id"), F.col("source_id"), F.col("event_id"))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed here.

    A filter on a computed column is pushed below the projections that compute it, which copies their
    expressions into the filter (a JSON text would be parsed once more per row). It cannot pass a
    generator's own output, so each row goes through one.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")
