"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. On each level equal neighbours become one symbol named by symbol and length; then deterministic
coin tossing gives every symbol a small label from itself and its left neighbour (twice the lowest bit in which
the two differ, plus that bit), repeated until labels are below 6; neighbours keep different labels. A phrase begins at each local maximum, so where
it begins depends on a few symbols to its left and one to its right only, and equal substrings are cut alike
except near their ends, wherever they stand. A phrase is named by a hash of its symbols, and the names are the next level's
symbols. The fingerprint is the KEPT smallest distinct names of levels 2 and 3 (about ten to forty characters); likeness of two
fingerprints is the share of names that both have among the KEPT smallest of the two together, an estimate of the
overlap of their sets of names. Of a long text the fingerprint holds few names, so two long texts with a common passage
mostly share none of them: ``names_of`` gives all names as rows, to be joined.

Null texts count as empty; an empty text has the empty fingerprint, which is like another empty one (1) and unlike any
other (0). Equal texts have equal fingerprints. Texts of a batch are parsed together in arrays; the order of documents
is by id, null ids first, repeated ids by checksum of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import documents_of, pieces, settled, texts_of

KEPT, LEVELS, CHARS = 32, (2, 3), 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def runs_named(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours of one text as one symbol: names, texts, and where each begins."""
    begin = np.ones(len(names), bool)
    begin[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(begin)
    if len(at) == len(names):
        return names, owner, at
    length = np.diff(at, append=len(names)).astype(np.uint64)
    names = names[at]
    long = length > 1
    names[long] = mixed(names[long] + _A * length[long])
    return names, owner[at], at


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different for neighbours of one text; ``first`` marks where texts begin."""
    for _ in range(4):  # values below 2**64, then 128, 14, 8, 6
        differ = symbols.copy()
        differ[1:] ^= symbols[:-1]
        lowest = np.bitwise_count(~differ & (differ - differ.dtype.type(1))).astype(np.uint8)
        lowest[first] = 0
        symbols = lowest * np.uint8(2) + ((symbols >> lowest.astype(symbols.dtype)) & symbols.dtype.type(1)).astype(np.uint8)
    return symbols


def phrases(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next level: names of the phrases, their texts, and where each begins."""
    first = np.ones(len(names), bool)
    first[1:] = owner[1:] != owner[:-1]
    small = np.uint32 if names.max() < 2**32 else np.uint64
    label = labels(names.astype(small), first)
    begin = first.copy()
    begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    at = np.flatnonzero(begin)
    place = (np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(names + _A * (place + np.uint64(1))), at)), owner[at], at


def sketches(texts: list[str]) -> list[tuple[int, ...]]:
    """Fingerprint of each text: its smallest names, ascending."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    if not len(owner):
        return [()] * len(texts)
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    found, owners = [], []
    for level in range(1, max(LEVELS) + 1):
        names, owner, _ = phrases(*runs_named(names, owner)[:2])
        if level in LEVELS:
            found.append((mixed(names + np.uint64(level)) >> np.uint64(32)).astype(np.int64))
            owners.append(owner)
    both = np.unique((np.concatenate(owners).astype(np.int64) << 32) | np.concatenate(found))
    owner, value = both >> 32, (both & 0xFFFFFFFF).tolist()
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    return [tuple(value[a : min(b, a + KEPT)]) for a, b in zip(cuts, cuts[1:])]


def names_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every phrase of levels LEVELS: doc_id, level, name (64 bits), place (its first character); nothing is left out."""
    source = documents_of(docs, doc_id, text)
    columns = ["doc_id", "level", "name", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=CHARS):
            texts = texts_of(batch)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
            if not len(owner):
                continue
            names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            for level in range(1, max(LEVELS) + 1):
                names, owner, at = runs_named(names, owner)
                place = place[at]
                names, owner, at = phrases(names, owner)
                place = place[at]
                if level in LEVELS:
                    found = [pa.array(np.full(len(names), level, np.int32)), pa.array(names.view(np.int64)), pa.array(place)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *found], columns)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, level int, name long, place long")


def likeness(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    union = sorted({*a, *b})[:KEPT]
    both = set(a).intersection(b)
    return sum(x in both for x in union) / len(union)


def written(sketch: tuple[int, ...]) -> str:
    return "".join(f"{x:08x}" for x in sketch)


def parsed(fingerprint: str) -> tuple[int, ...]:
    return tuple(int(fingerprint[i : i + 8], 16) for i in range(0, len(fingerprint), 8))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (8 hex digits per name)."""
    source = documents_of(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=CHARS):
            out = pa.array(map(written, sketches(texts_of(batch))), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def written_likeness(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else likeness(parsed(a), parsed(b))


def alike(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null with a null."""
    return F.udf(written_likeness, "double", useArrow=True)(a, b)


RESULT = pa.schema(
    [
        ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)
COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter of the text's characters replaced by the first as many of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compared(texts: list[str], following: list[str]) -> dict[str, list]:
    """Columns of RESULT for texts and the texts after them; ``following[i]`` is often ``texts[i + 1]``."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    shift = all(a is b for a, b in zip(texts[1:], following))
    every = sketches([*texts, *(following[-1:] if shift else following), *changed])
    own, new = every[: len(texts)], every[len(every) - len(texts) :]
    after = every[1 : len(texts) + 1] if shift else every[len(texts) : 2 * len(texts)]
    return {
        "n_chars": list(map(len, texts)),
        "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
        "fingerprint": list(map(written, own)),
        "edited_fingerprint": list(map(written, new)),
        "near_edited": list(map(likeness, own, new)),
        "near_next": list(map(likeness, own, after)),
    }


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and RESULT, the document against the next one and against its own text edited by the next.

    Documents are dealt out by ranges of the id and sorted within, so nearly all next documents are in the same task.
    Each task hands on its first and its last document; those few (two per task) are joined by task.
    """
    source = documents_of(docs, doc_id, text).withColumn("crc", F.crc32(F.encode("text", "UTF-8")))
    ordered = source.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc").select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in pieces(batches, limit=CHARS):
            texts, ids = texts_of(batch), batch.column(0)
            if held is None:
                yield rows(ids[:1], part, "first", texts[:1], None)
            else:
                texts, ids = [held[1], *texts], pa.concat_arrays([held[0], ids])
            if len(texts) > 1:
                yield rows(ids[:-1], part, "done", None, compared(texts[:-1], texts[1:]))
            held = ids[-1:], texts[-1]
        if held:
            yield rows(held[0], part, "last", [held[1]], None)

    def rows(ids, part, role, texts, result):
        n = len(ids)
        columns = [ids, pa.array([part] * n, pa.int64()), pa.array([role] * n), pa.array(texts or [None] * n, pa.string())]
        columns += [pa.array(result[f.name] if result else [None] * n, f.type) for f in RESULT]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "role", "text", *RESULT.names])

    every = settled(ordered.mapInArrow(run, f"doc_id {kind}, part long, role string, text string, {COLUMNS}"))
    parts = every.where("role = 'first'").select("part")
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    heads = every.where("role = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    ends = every.where("role = 'last'").join(parts.select("part", after.alias("after")), "part").join(heads, "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: these are whole documents
                result = compared([batch.column(1)[i].as_py()], [batch.column(2)[i].as_py()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *(pa.array(result[f.name], f.type) for f in RESULT)], ["doc_id", *RESULT.names]
                )

    closed = ends.select("doc_id", "text", "following").mapInArrow(close, f"doc_id {kind}, {COLUMNS}")
    return every.where("role = 'done'").select("doc_id", *RESULT.names).union(closed)
