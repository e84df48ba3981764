"""Byte-level BPE encoding and decoding by padded numpy matrices.

The distinct pieces of a batch (matches of the split pattern) are put into buckets by length; a bucket is one
padded matrix of ids with the matrix of its neighbours' ranks. In every round each row merges its leftmost
pair of minimum rank, two changed ranks per row are looked up in a hash table of pairs, the columns right of the
merge move left by one, and rows without a further merge leave the matrix (compaction). A piece that is itself a
token needs no merge. Pieces beyond LONG bytes are handled row by row: all leftmost, non-overlapping
occurrences of the row's minimum rank merge in one round, which is the same result as one at a time as long as no
merge makes a pair of smaller rank; where one does, only the leftmost merges in that round.

The split by the public pattern is computed on arrays of character classes (``Splitter``); any other pattern is
run as a regular expression.

Null texts count as empty and give no ids; empty texts too. Repeated rows give repeated rows. Every row is
encoded in the task that read it; nothing is shuffled, and a worker holds one batch of about a million bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tributary.llm.common import documents_of, pieces, texts_of

NONE = np.int32(2**31 - 1)
LONG = 256
#: Bytes of text that a worker splits at once.
BATCH = 1_000_000


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of what they merge to."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = self.keys[slot[open_]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[open_][free], return_index=True)
            put = open_[free][first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], rank[put]
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE for no merge. Negative ids (padding) merge with nothing."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NONE)
        rest = np.flatnonzero((there != keys) & (there != np.uint64(2**64 - 1)))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (there != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Vocabulary:
    """Ranks of a vocabulary file: one line per token, its bytes in base64 and its rank."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        found = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None
        ]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank.astype(np.int32))

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, where each part's ids begin: one more than parts)."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        get = self.ranks.get
        whole = np.fromiter((get(p, -1) for p in parts), np.int32, len(parts))
        at = np.flatnonzero(whole >= 0)
        done.append((at, np.ones(len(at), np.int64), whole[at]))
        rest = np.flatnonzero(whole < 0)
        sizes = np.fromiter((len(parts[i]) for i in rest), np.int64, len(rest))
        low = 0
        for width in (4, 8, 12, 16, 24, 32, 64, 128, LONG):
            rows = rest[(sizes > low) & (sizes <= width)]
            if len(rows):
                done += self._bucket(rows, [parts[i] for i in rows], width)
            low = width
        done += [self._long(i, parts[i]) for i in rest[sizes > LONG]]
        counts = np.zeros(len(parts), np.int64)
        for row, n, _ in done:
            counts[row] = n
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(starts[-1], np.int32)
        for row, n, flat in done:
            ids[spread(starts[row], n)] = flat
        return ids, starts

    def _bucket(self, rows: np.ndarray, parts: list[bytes], width: int):
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
        ids = self.byte_ids[raw]
        ids[np.arange(width) >= np.fromiter(map(len, parts), np.int64, len(parts))[:, None]] = -1
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(parts), width - 1)
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                kept = ids[over]
                real = kept >= 0
                yield rows[over], real.sum(1), kept[real]
                rows, ids, ranks, at, best = (x[~over] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    return
            each = np.arange(len(rows))
            ids[each, at] = best
            ids = np.where(np.arange(ids.shape[1] - 1) > at[:, None], ids[:, 1:], ids[:, :-1])
            ranks = np.where(np.arange(ranks.shape[1] - 1) > at[:, None], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                some = at > 0
                ranks[each[some], at[some] - 1] = self.pairs.get(ids[each[some], at[some] - 1], ids[each[some], at[some]])
                some = at < ranks.shape[1]
                ranks[each[some], at[some]] = self.pairs.get(ids[each[some], at[some]], ids[each[some], at[some] + 1])

    def _long(self, row: int, part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.byte_ids[np.frombuffer(part, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            nth = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
            merged = self._merge(ids, ranks, best, at[nth % 2 == 0])
            ids, ranks = merged if merged else self._merge(ids, ranks, best, at[:1])
        return np.array([row]), np.array([len(ids)]), ids

    def _merge(self, ids: np.ndarray, ranks: np.ndarray, best: np.int32, at: np.ndarray):
        """Ids and ranks after the merges at these places; None if one after the other would have gone another way,
        that is, if a merge makes a pair of smaller rank while the places after it are as they were."""
        after = np.append(ids, np.int32(-1))[at + 2]
        if len(at) > 1 and (self.pairs.get(np.full(len(at), best), after) < best).any():
            return None
        out = ids.copy()
        out[at] = best
        out, ranks = np.delete(out, at + 1), np.delete(ranks, at)
        where = at - np.arange(len(at))
        near = np.unique(np.concatenate([where[where > 0] - 1, where[where < len(out) - 1]]))
        ranks[near] = self.pairs.get(out[near], out[near + 1])
        if len(at) > 1 and (ranks[where[where > 0] - 1] < best).any():
            return None
        return out, ranks

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: The split pattern that ``Splitter`` computes (a fixed value).
CLASS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, SPACE, LETTER, NUMBER = range(4)


def character_classes() -> bytes:
    """The class of each code point, by the regular expressions' own tables."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for number, kind in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(kind, every):
            out[ord(every[found.start()]) : ord(every[found.end() - 1]) + 1] = number
    return out.tobytes()


class Splitter:
    """Matches of CLASS_PATTERN over many texts at once.

    A piece is a run of one class; a blank before a run that is no white space joins it; a run of white space
    before such a run gives up its last character; an apostrophe that begins a piece takes s, t, m, d, re, ve or ll.
    """

    def __init__(self, classes: bytes):
        self.classes = np.frombuffer(classes, np.uint8)

    def split(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """(all pieces as UTF-8, how many each text has)."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(chars):
            return [], np.zeros(len(texts), np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.zeros(len(chars) + 1, bool)
        first[np.cumsum(lengths)] = first[0] = True
        kind = self.classes[chars]
        run = first[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begin = run.copy()
        follows = run & ~first[:-1] & (kind != SPACE)  # a run in a text's midst, not of white space
        at = np.flatnonzero(follows)
        white = at[kind[at - 1] == SPACE]
        begin[white - 1] = True
        begin[white[chars[white - 1] == 32]] = False
        quote = np.flatnonzero((chars == 39) & begin)
        quote = quote[quote + 1 < len(chars)]
        quote = quote[~first[quote + 1]]
        one = np.append(chars, [0, 0])[quote + 1]
        two = np.where(first[np.minimum(quote + 2, len(chars))], 0, np.append(chars, [0, 0])[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begin = np.append(begin, [True, True])
        begin[quote[short | long] + 1] = False
        begin[quote[short] + 2] = True
        begin[quote[long] + 3] = True
        begin = begin[: len(chars)]
        width = 1 + (chars > 0x7F).astype(np.int8) + (chars > 0x7FF) + (chars > 0xFFFF)
        raw, places = "".join(texts).encode(), np.flatnonzero(begin)
        cuts = np.append((np.cumsum(width, dtype=np.int64) - width)[places], len(raw)).tolist()
        counts = np.diff(np.searchsorted(places, np.concatenate([[0], np.cumsum(lengths)])))
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])], counts


class Matches:
    """Matches of any pattern."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall

    def split(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        found = [self.find(t) for t in texts]
        return [p.encode() for x in found for p in x], np.array(list(map(len, found)), np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each of the runs, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=2)
def loaded(lines: bytes) -> Vocabulary:
    """Built once per worker process, which serves many tasks."""
    return Vocabulary(lines)


def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return loaded(f.read())


def encode(docs: DataFrame, path: str, pattern: str, decode: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>; with ``decode`` also the bytes that the ids stand for, decoded binary.

    The vocabulary file is read on the driver and broadcast (its size is that of the vocabulary, not of the data).
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())
    classes = spark.sparkContext.broadcast(character_classes() if pattern == CLASS_PATTERN else b"")
    source = documents_of(docs, doc_id, text)
    id_type = source.schema["doc_id"].dataType.simpleString()
    made = "doc_id " + id_type + ", ids array<int>" + (", decoded binary" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(lines.value)
        splitter = Splitter(classes.value) if classes.value else Matches(pattern)
        for batch in pieces(batches, limit=BATCH):
            parts, each = splitter.split(texts_of(batch))
            index: dict[bytes, int] = {}
            number = index.setdefault
            part = np.array([number(p, len(index)) for p in parts], np.int64)
            flat, begins = vocabulary.encode(list(index))
            counts = np.diff(begins)[part]
            ids = flat[spread(begins[part], counts)]
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *each])].astype(np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            names = ["doc_id", "ids"]
            if decode:
                names.append("decoded")
                columns.append(pa.array([vocabulary.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, made)


def decode(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of tokens: doc_id, decoded binary. Null ids count as none."""
    spark = tokens.sparkSession
    with open(path, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())
    source = tokens.select(tokens[doc_id].alias("doc_id"), tokens[ids].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(lines.value)
        for batch in batches:
            out = pa.array([vocabulary.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "decoded"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, decoded binary")
