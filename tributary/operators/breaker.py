"""The circuit breaker at every call: which calls are refused follows from the outcomes of earlier ones.

Per model the calls have one order (``at``, ``event_id``, ``fallback_for``). A closed breaker lets a call through and counts
failures in a row; at ``breaker_threshold`` it opens. An open one refuses calls until ``breaker_reset_s`` after
it opened, then lets one through: a success closes it, a failure opens it anew. Refused calls change nothing.

That is a state machine over all calls of a model, which must not be one task. Its steps compose, so
it is evaluated as a prefix scan on two levels:

1. Calls are sorted by range of (model, order) and checkpointed; a partition's calls of one model are a block.
2. Each block is walked once for *every* state it could be entered in: closed with 0 to threshold - 1 failures, or open since
   an unknown time t, which only decides the first call at or after t + reset. Paths that reach the same state are
   one from there on, so a call costs a constant amount. At most the calls of one reset time are different answers.
3. One row per block is folded in order, per model, row by row: the state each block is entered in.
4. Each block is walked again from that state.

Null ``at`` sorts first and counts as the earliest time, a null ``ok`` is a failure. Equal orders (the same call twice)
keep any order among themselves. No rows in, no rows out. Other columns pass through unchanged.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tributary.operators.registry import FALLBACK_TIMEOUT_MS, REGISTRY, Registry
from tributary.operators.scoring import classify_outcome
from tributary.session import shared_folder
from tributary.settings import DEFAULTS, Settings

# opened_us is null while closed.
_STATE = "struct<failures:int,opened_us:bigint>"
_BLOCK = f"model_name string, _part int, closed array<{_STATE}>, pieces array<struct<until:bigint,failures:int,opened_us:bigint>>"
_ENTERED = "model_name string, _part int, _failures int, _opened_us bigint"


class _Paths:
    """One block walked from every entering state at once; ``_into`` joins paths that have met."""

    def __init__(self, threshold: int, reset_us: int) -> None:
        self.reset_us = reset_us
        self._into = list(range(threshold))
        self.closed: list[int | None] = list(range(threshold))
        self.opened: deque[tuple[int, int]] = deque()
        self.pieces: list[tuple[int, int]] = []
        self.first: int | None = None
        self.waiting = True  # entered open, and no call yet that would be let through whatever the time of opening

    def _root(self, path: int) -> int:
        while self._into[path] != path:
            self._into[path] = self._into[self._into[path]]
            path = self._into[path]
        return path

    def _joined(self, paths: list[int]) -> int | None:
        for path in paths[1:]:
            self._into[path] = paths[0]
        return paths[0] if paths else None

    def step(self, at: int, ok: bool) -> None:
        tried = []
        while self.opened and self.opened[0][0] + self.reset_us <= at:
            tried.append(self.opened.popleft()[1])
        if self.first is None:
            self.first = at
        if self.waiting:
            # It opened before this block, so by the first call's time plus the reset every such path has been tried.
            self.waiting = at < self.first + self.reset_us
            path = len(self._into)
            self._into.append(path)
            self.pieces.append((at, path))
            tried.append(path)
        if ok:
            self.closed[0] = self._joined([p for p in self.closed if p is not None] + tried)
            self.closed[1:] = [None] * (len(self.closed) - 1)
            return
        last = self.closed.pop()
        self.closed.insert(0, None)
        met = self._joined(tried if last is None else [*tried, last])
        if met is not None:
            self.opened.append((at, met))

    def exits(self) -> tuple[list[tuple[int, int | None]], list[tuple[int, int, int | None]]]:
        """The state at the end per closed state, and per piece of the times until which an open one would refuse."""
        ends = {path: (failures, None) for failures, path in enumerate(self.closed) if path is not None}
        ends |= {path: (len(self.closed), at) for at, path in self.opened}
        pieces: list[tuple[int, int, int | None]] = []
        for until, path in self.pieces:
            end = ends[self._root(path)]
            if pieces and pieces[-1][1:] == end:
                pieces.pop()
            pieces.append((until, *end))
        return [ends[self._root(path)] for path in range(len(self.closed))], pieces


def _walked(threshold: int, reset_us: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("model_name", pa.string()),
                ("_part", pa.int32()),
                ("closed", pa.list_(pa.struct([("failures", pa.int32()), ("opened_us", pa.int64())]))),
                ("pieces", pa.list_(pa.struct([("until", pa.int64()), ("failures", pa.int32()), ("opened_us", pa.int64())]))),
            ]
        )

        def row(model: str, part: int, paths: _Paths) -> pa.RecordBatch:
            closed, pieces = paths.exits()
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "model_name": model,
                        "_part": part,
                        "closed": [{"failures": f, "opened_us": o} for f, o in closed],
                        "pieces": [{"until": u, "failures": f, "opened_us": o} for u, f, o in pieces],
                    }
                ],
                schema=schema,
            )

        block, paths = None, None
        for batch in batches:
            for name, part, at, ok in zip(*(batch.column(c).to_pylist() for c in ("model_name", "_part", "_at", "_ok"))):
                if (name, part) != block:
                    if paths is not None:
                        yield row(*block, paths)
                    block, paths = (name, part), _Paths(threshold, reset_us)
                paths.step(at, ok)
        if paths is not None:
            yield row(*block, paths)

    return walk


def _folded(reset_us: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, failures, opened = None, 0, None
        for batch in batches:
            out = []
            for block in batch.to_pylist():
                if block["model_name"] != model:
                    model, failures, opened = block["model_name"], 0, None
                out.append({"model_name": model, "_part": block["_part"], "_failures": failures, "_opened_us": opened})
                if opened is None:
                    end = block["closed"][failures]
                else:
                    until = opened + reset_us
                    end = next((p for p in block["pieces"] if until <= p["until"]), None)
                if end is not None:
                    failures, opened = end["failures"], end["opened_us"]
            yield pa.RecordBatch.from_pylist(
                out,
                schema=pa.schema(
                    [("model_name", pa.string()), ("_part", pa.int32()), ("_failures", pa.int32()), ("_opened_us", pa.int64())]
                ),
            )

    return fold


def _replayed(threshold: int, reset_us: int):
    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, failures, opened = None, 0, None
        names = ("model_name", "_part", "_at", "_ok", "_failures", "_opened_us")
        for batch in batches:
            before, states = [], []
            for name, part, at, ok, entered, entered_us in zip(*(batch.column(c).to_pylist() for c in names)):
                if (name, part) != block:
                    block, failures, opened = (name, part), entered, entered_us
                refused = opened is not None and at < opened + reset_us
                before.append(failures)
                states.append("CLOSED" if opened is None else "OPEN" if refused else "HALF_OPEN")
                if refused:
                    continue
                failures = 0 if ok else min(failures + 1, threshold)
                opened = at if failures == threshold else None
            kept = [c for c in batch.schema.names if c not in names[1:]]
            columns = [batch.column(c) for c in kept] + [pa.array(before, pa.int32()), pa.array(states, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "breaker_failures", "breaker"])

    return replay


def breaker_calls(
    calls: DataFrame,
    ok: Column,
    at: str = "called_at",
    settings: Settings = DEFAULTS,
    registry: Registry = REGISTRY,
    before: DataFrame | None = None,
) -> DataFrame:
    """Calls of registered models with the breaker as each call met it.

    ``ok`` is the outcome the call has if it is let through. Adds ``breaker`` (CLOSED, HALF_OPEN: let through; OPEN: refused) and
    ``breaker_failures`` (failures in a row before the call, up to the threshold, where they stay while it is open).
    ``before`` is the state to go on from (see ``breaker_after``), one row per model; by default all are closed.
    """
    spark = calls.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    threshold, reset_us = settings.breaker_threshold, settings.breaker_reset_s * 1_000_000
    known = calls.filter(F.col("model_name").isin(*[m.name for m in registry.models])).withColumns(
        {
            "_at": F.coalesce(F.unix_micros(at), F.lit(-(2**62))),
            "_ok": F.coalesce(ok, F.lit(False)),
        }
    )
    order = ["model_name", "_at", "event_id", *[c for c in ("fallback_for",) if c in calls.columns]]
    ordered = known.repartitionByRange(*order).sortWithinPartitions(*order)
    # A checkpoint keeps partitions and their order, also when an executor is lost between the two walks.
    sorted_calls = ordered.withColumn("_part", F.spark_partition_id()).checkpoint()
    blocks = sorted_calls.select("model_name", "_part", "_at", "_ok").mapInArrow(_walked(threshold, reset_us), _BLOCK)
    if before is not None:
        # A block before the first one, after which the breaker is as given however it was entered.
        state = F.struct(F.col("failures").cast("int").alias("failures"), F.unix_micros("opened_at").alias("opened_us"))
        always = F.struct(F.lit(2**63 - 1).alias("until"), state["failures"].alias("failures"), state["opened_us"].alias("opened_us"))
        carried = before.select(
            "model_name", F.lit(-1).alias("_part"), F.array_repeat(state, threshold).alias("closed"), F.array(always).alias("pieces")
        )
        blocks = blocks.unionByName(carried)
    entered = (
        blocks.repartition("model_name")
        .sortWithinPartitions("model_name", "_part")
        .mapInArrow(_folded(reset_us), _ENTERED)
    )
    added = [StructField("breaker_failures", IntegerType()), StructField("breaker", StringType())]
    schema = StructType([*calls.schema.fields, *added])
    # One row per partition and registered model that meet: at most partitions + models.
    met = sorted_calls.join(F.broadcast(entered), ["model_name", "_part"])
    return met.select(*calls.columns, "_part", "_at", "_ok", "_failures", "_opened_us").mapInArrow(
        _replayed(threshold, reset_us), schema
    )


def breaker_after(
    met: DataFrame,
    ok: Column,
    at: str = "called_at",
    settings: Settings = DEFAULTS,
    before: DataFrame | None = None,
) -> DataFrame:
    """``model_name, failures, opened_at`` after the calls of ``breaker_calls``, to go on from with later calls.

    The last call let through decides; a model of ``before`` without one stays as it was. One row per model, found by a
    maximum that is combined before the shuffle.
    """
    order = [at, "event_id", *[c for c in ("fallback_for",) if c in met.columns]]
    last = F.struct(*order, "breaker_failures", F.coalesce(ok, F.lit(False)).alias("ok"), F.col(at).alias("at"))
    ends = met.filter(F.col("breaker") != "OPEN").groupBy("model_name").agg(F.max(last).alias("_last"))
    failures = F.when(F.col("_last.ok"), F.lit(0)).otherwise(
        F.least(F.col("_last.breaker_failures") + 1, F.lit(settings.breaker_threshold))
    )
    ends = ends.select("model_name", failures.alias("failures"), "_last.at")
    opened = F.when(F.col("failures") == settings.breaker_threshold, F.col("at"))
    ends = ends.select("model_name", "failures", opened.alias("opened_at"))
    if before is None:
        return ends
    return ends.unionByName(before.select(*ends.columns).join(ends, "model_name", "left_anti"))


def call_outcomes(log: DataFrame, settings: Settings = DEFAULTS, registry: Registry = REGISTRY) -> DataFrame:
    """The calls that are really made, with their outcome under the breakers.

    ``log`` says how each call would end: ``event_id, model_name, called_at, latency_ms, failed`` and ``fallback_for``
    (the primary in whose place it would be made; null for a routed call). A fallback is called only
    where its primary did not succeed, and its breaker knows those calls only, so models that are fallbacks come after
    their primaries. Adds ``breaker``, ``breaker_failures`` and ``outcome`` (success, timeout, error, circuit_open).
    """
    names = {m.name for m in registry.models}
    users = {m.name: {p.name for p in registry.models if p.fallback == m.name} for m in registry.models}
    done: set[str] = set()
    results: list[DataFrame] = []
    while done < names:
        level = sorted(n for n in names - done if users[n] <= done)
        if not level:
            raise ValueError(f"fallbacks in a circle: {sorted(names - done)}")
        calls = log.filter(F.col("model_name").isin(*level))
        primaries = {p for n in level for p in users[n]}
        routed = calls.filter(F.col("fallback_for").isNull())
        if primaries:
            missed = [
                r.filter(F.col("model_name").isin(*primaries) & (F.col("outcome") != "success")).select(
                    "event_id", F.col("model_name").alias("fallback_for")
                )
                for r in results
            ]
            wanted = missed[0]
            for more in missed[1:]:
                wanted = wanted.unionByName(more)
            calls = routed.unionByName(calls.join(wanted, ["event_id", "fallback_for"], "left_semi").select(*log.columns))
        else:
            calls = routed
        limit = F.when(F.col("fallback_for").isNull(), registry.lookup(F.col("model_name"), "timeout_ms")).otherwise(
            F.lit(FALLBACK_TIMEOUT_MS)
        )
        by_itself = classify_outcome(F.col("latency_ms"), F.col("failed"), F.lit(False), limit)
        met = breaker_calls(calls, by_itself == "success", settings=settings, registry=registry)
        refused = F.col("breaker") == "OPEN"
        results.append(met.withColumn("outcome", F.when(refused, "circuit_open").otherwise(by_itself)))
        done |= set(level)
    made = results[0]
    for result in results[1:]:
        made = made.unionByName(result)
    return made


def logged_calls(made: DataFrame) -> DataFrame:
    """Outcomes as a call log for ``attach_call_log``: refused calls are marked."""
    return made.select(
        "event_id", "model_name", "called_at", "latency_ms", "failed", (F.col("outcome") == "circuit_open").alias("breaker_open")
    )
