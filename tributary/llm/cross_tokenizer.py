"""Alignment of the tokens of two tokenizers by the bytes they stand for.

Tokenizer A is byte-level BPE (a tokenizers file), B a sentencepiece model, which puts a blank before the text; A gets that blank with the
text. Of each side a dictionary leads from the byte at which a token ends to its number. The keys that both dictionaries hold
(a hash-set intersection), sorted, cut both lists of ids into slices of the same bytes, the groups. Within a slice no further end is common, so each end of
either side closes one overlap, and the slice expands to its links: the pairs of tokens that share bytes.

A text has no tokens if it is null or empty, or if the bytes of either side's tokens, joined, are not a blank and the text.
Special tokens' strings in texts are plain text. Repeated rows stay, no rows give no rows, other columns stay behind.

``counted`` also counts, for every pair of ids, the documents of the corpus that hold it linked. Counts come in two steps: each task
numbers the distinct pairs of a chunk of about CHUNK bytes of text and writes the chunk as one row of a table (its documents' figures, and which
pairs each holds how often); only (chunk, pair) rows are shuffled, so the most frequent pair has one row per chunk and not one per link or
document. Totals of pairs are joined back by pair, then by chunk, and summed up per document. A group of the window is one id's pairs,
as many as the other vocabulary has ids at most; a chunk's rows are bounded by its text. The table is written, so lost executors do
not encode again.

A's ids come from tiktoken on the ranks in A's own file, which is several times as fast as the library and gives the same ids; a text with
characters that are newer than Unicode 3.2, on whose class two pattern engines may disagree, goes through the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm.common import documents_of, pieces, shared_folder, texts_of

CHUNK, CACHE = 2_000_000, 200_000
#: A word with the blanks before it; blanks at the end.
WORDS = re.compile(" *[^ ]+| +")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=200_000)
def settled_character(c: str) -> bool:
    """Whether the character has its class since Unicode 3.2."""
    return unicodedata.ucd_3_2_0.category(c) == unicodedata.category(c) != "Cn"


class ByteLevel:
    """A: ids of texts, and each id's bytes."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.library = Tokenizer.from_str(file)
        self.library.encode_special_tokens = True
        model, of = json.loads(file)["model"], byte_characters()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(of.__getitem__, token))
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ranked = all(vocabulary[m] == 256 + i for i, m in enumerate(merges))
        ranks = {b: i for i, b in enumerate(self.bytes)}
        same = ranked and len(ranks) == len(self.bytes) == 256 + len(merges)
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None

    def ids(self, texts: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and (t.isascii() or all(map(settled_character, set(t)))) for t in texts]
        rest = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain)]


class Pieces:
    """B: ids of texts, and each id's bytes.

    No piece of the vocabulary has a blank after another character, so no merge crosses the place before a word's blanks, and a text's
    ids are its words' ids. The first CACHE words stay known. A vocabulary of another kind, and texts with U+2581 itself, go through the library whole.
    """

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        found = list(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(found)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in found) and self.model.encode("a  b") == self.model.encode("a") + self.model.encode(" b")
        #: A single blank at the end, which cannot stand alone: the library encodes an empty text as nothing.
        self.blank = array("I", self.model.encode("a ")[len(self.model.encode("a")) :]).tobytes()
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        split = [WORDS.findall(f" {t}") if self.by_word and "▁" not in t else None for t in texts]
        new = list({w for words in split if words for w in words if w not in known} - {" "})
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            known.update(zip(some, self._encoded([w[1:] for w in some])))  # the library puts the first blank before them
        known[" "] = self.blank
        rest = iter(self._encoded([t for t, words in zip(texts, split) if words is None]))
        out = [b"".join(map(known.__getitem__, words)) if words is not None else next(rest) for words in split]
        for word in new[max(0, len(new) - (len(known) - CACHE)) :] if len(known) > CACHE else ():
            del known[word]
        return [np.frombuffer(ids, np.uint32).astype(np.int64) for ids in out]


class Strings:
    """A table of byte strings, joined by their numbers."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array(list(map(len, strings)), np.int32)
        self.begin = np.cumsum(self.size, dtype=np.int32) - self.size

    def join(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        place = np.repeat((self.begin[numbers] - (ends - size)).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        return self.flat[place]


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """For each group, how many tokens of A, and of B, end with it or before."""
    a, b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(a.keys() & b.keys())
    return list(map(a.__getitem__, common)), list(map(b.__getitem__, common))


class Slices:
    """The groups of one text, or of many whose tokens and ends are numbered on, as slices of both lists of tokens."""

    def __init__(self, cut_a: np.ndarray, cut_b: np.ndarray):
        self.from_a, self.from_b = (np.concatenate([[0], c]).astype(np.int64)[:-1] for c in (cut_a, cut_b))
        self.to_a, self.to_b = cut_a, cut_b
        self.n_a, self.n_b = cut_a - self.from_a, cut_b - self.from_b
        self.n = self.n_a + self.n_b - 1  # links

    def links(self, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of both tokens of each link, slice by slice: where one side has one token, it with each of the
        other side's; elsewhere each end of either side closes one overlap."""
        group = np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(group)) - (np.cumsum(self.n) - self.n)[group]
        one_a, one_b = self.n_a == 1, self.n_b == 1
        a = self.from_a[group] + np.where(one_b[group], place, 0)
        b = self.from_b[group] + np.where(one_a[group], place, 0)
        mixed = ~(one_a | one_b)
        ends = np.sort(np.concatenate([ends_a[np.repeat(mixed, self.n_a)], ends_b[np.repeat(mixed, self.n_b)]]))
        ends = ends[np.diff(ends, prepend=-1) != 0]
        a[mixed[group]], b[mixed[group]] = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        return a, b

    def spelling(self, ids_a: np.ndarray, ids_b: np.ndarray, n_ids_a: int) -> np.ndarray:
        """Both lists of ids in the order of ``a1,a2|b1;a3|b2,b3``, as places in ``spellings``."""
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[self.to_a - 1] = last_b[self.to_b - 1] = 1
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + np.repeat(self.from_b, self.n_a)] = 2 * ids_a + last_a
        out[np.arange(len(ids_b)) + np.repeat(self.to_a, self.n_b)] = 2 * (n_ids_a + ids_b) + last_b
        return out


def spellings(n_ids_a: int, n_ids_b: int) -> Strings:
    """Each id with what follows it, within its side of a group and at its end."""
    return Strings([b"%d%c" % (i, c) for n, ends in ((n_ids_a, b",|"), (n_ids_b, b",;")) for i in range(n) for c in ends])


class Both:
    """Both tokenizers of a worker."""

    def __init__(self, file: str, model: bytes):
        self.a, self.b = ByteLevel(file), Pieces(model)
        self.size_a, self.bytes_b = np.array(list(map(len, self.a.bytes)), np.int64), Strings(self.b.bytes)
        self.spellings = spellings(len(self.a.bytes), len(self.b.bytes))

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of A, ids of B, their ends, cuts of A and B) per text; all empty for a text without tokens."""
        there = [t for t in texts if t]
        found = zip(self.a.ids([f" {t}" for t in there]), self.b.ids(there))
        for text in texts:
            if text:
                a, b = next(found)
                # A's bytes are the text's: it has no normalizer, and a token for each byte.
                if np.array_equal(self.bytes_b.join(b), np.frombuffer(b" " + text.encode(), np.uint8)):
                    a = np.array(a, np.int64)
                    ends = np.cumsum(self.size_a[a]), np.cumsum(self.bytes_b.size[b], dtype=np.int64)
                    yield a, b, *ends, *(np.array(c, np.int64) for c in cuts(*(e.tolist() for e in ends)))
                    continue
            yield (np.zeros(0, np.int64),) * 6


@lru_cache(maxsize=1)
def loaded(file: str, model: bytes) -> Both:
    """Built once per worker process, which serves many tasks."""
    return Both(file, model)


def _files(docs: DataFrame, path_a: str, path_b: str):
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # two vocabularies, whatever the data


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, a_ids, b_ids, groups (a_end and b_end: tokens of either side up to the group's end) and links
    (a and b: token numbers from 0, in the order of the bytes)."""
    files, source = _files(docs, path_a, path_b), documents_of(docs, doc_id, text)
    ints = pa.list_(pa.int32())
    kinds = [ints, ints, *(pa.list_(pa.struct([(x, pa.int32()), (y, pa.int32())])) for x, y in (("a_end", "b_end"), ("a", "b")))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(*files.value)
        for batch in pieces(batches):
            rows = []
            for a, b, ends_a, ends_b, *cut in both.align(texts_of(batch)):
                groups = [{"a_end": x, "b_end": y} for x, y in zip(*(c.tolist() for c in cut))]
                linked = zip(*(k.tolist() for k in Slices(*cut).links(ends_a, ends_b)))
                rows.append((a, b, groups, [{"a": x, "b": y} for x, y in linked]))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "a_ids", "b_ids", "groups", "links"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, groups array<struct<a_end: int, b_end: int>>, links array<struct<a: int, b: int>>"
    )


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def write_chunks(docs: DataFrame, path: str, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes the table of chunks to the folder ``path`` and returns it. A row: chunk, docs (per document doc_id, n_a, n_b, n_groups,
    n_links, groups_sha256, pairs: its number of distinct pairs), places and times (32-bit numbers: the documents' distinct pairs as
    places in ``codes``, and how many links each is), codes (the chunk's distinct pairs, A's id * size of B + B's id) and held (documents with each)."""
    files, source = _files(docs, path_a, path_b), documents_of(docs, doc_id, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(*files.value)
        chunk, size_b = TaskContext.get().partitionId() << 32, len(both.b.bytes)
        for batch in pieces(batches, limit=CHUNK):
            found = list(zip(*both.align(texts_of(batch))))
            counts = [np.array(list(map(len, x)), np.int64) for x in found]
            n_a, n_b, n_groups = counts[0], counts[1], counts[4]
            a, b, ends_a, ends_b, cut_a, cut_b = map(np.concatenate, found)
            before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            size = np.array([e[-1] if len(e) else 0 for e in found[2]], np.int64)
            before = np.cumsum(size) - size  # bytes, so that the documents' ends go on
            slices = Slices(cut_a + np.repeat(before_a, n_groups), cut_b + np.repeat(before_b, n_groups))
            i, j = slices.links(ends_a + np.repeat(before, n_a), ends_b + np.repeat(before, n_b))
            n_links = n_a + n_b - n_groups
            owner = np.repeat(np.arange(len(n_a)), n_links)
            keys, times = np.unique(owner * (len(both.a.bytes) * size_b) + a[i] * size_b + b[j], return_counts=True)
            n_pairs = np.bincount(keys // (len(both.a.bytes) * size_b), minlength=len(n_a))
            distinct, place = np.unique(keys % (len(both.a.bytes) * size_b), return_inverse=True)
            order = slices.spelling(a, b, len(both.a.bytes))
            text = memoryview(both.spellings.join(order))
            ends = np.concatenate([[0], np.cumsum(both.spellings.size[order], dtype=np.int64)])[np.cumsum(n_a + n_b)].tolist()
            digests = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip([0, *ends], ends)]
            figures = [n_a, n_b, n_groups, n_links, digests, n_pairs]
            names = [*FIGURES, "groups_sha256", "pairs"]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int32()]
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(figures, kinds))]
            documents = pa.StructArray.from_arrays(columns, ["doc_id", *names])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(documents)], pa.int32()), documents),
                    pa.array([place.astype("<i4").tobytes()], pa.binary()), pa.array([times.astype("<i4").tobytes()], pa.binary()),
                    pa.array([distinct], pa.list_(pa.int64())), pa.array([np.bincount(place, minlength=len(distinct))], pa.list_(pa.int64())),
                ],
                ["chunk", "docs", "places", "times", "codes", "held"],
            )
            chunk += 1

    documents = f"docs array<struct<doc_id: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, pairs: int>>"
    made = source.mapInArrow(run, f"chunk long, {documents}, places binary, times binary, codes array<long>, held array<long>")
    made.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return path


def pair_counts(chunks: DataFrame, size_b: int) -> DataFrame:
    """(code, a, b, documents, best) of all linked pairs: how many documents hold it, and whether no pair of A's id has more."""
    held = chunks.select(F.explode(F.arrays_zip("codes", "held")).alias("pair")).groupBy(F.col("pair.codes").alias("code"))
    counts = held.agg(F.sum("pair.held").alias("documents")).withColumn("a", F.floor(F.col("code") / size_b))
    most = F.max("documents").over(Window.partitionBy("a"))
    return counts.select("code", "a", (F.col("code") - F.col("a") * size_b).alias("b"), "documents", (F.col("documents") == most).alias("best"))


def counted(docs: DataFrame, path_a: str, path_b: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A id's most frequent, ties included),
    count_sum (documents holding the pair, over links), groups_sha256 (of the groups as text; without tokens '').

    ``folder`` takes the table of chunks; by default a new one beside the checkpoints."""
    folder = folder or f"{shared_folder(docs)}/chunks-{uuid.uuid4().hex}"
    chunks, documents = (docs.sparkSession.read.parquet(folder) for folder in [write_chunks(docs, folder, path_a, path_b, doc_id, text)] * 2)
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = chunks.select("chunk", F.posexplode("codes").alias("place", "code"))
    counts = pair_counts(chunks, size_b).select("code", "documents", "best")
    looked_up = rows.join(counts, "code").select("chunk", "place", "documents", "best")
    kind = chunks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    names = ["doc_id", *FIGURES, "groups_sha256"]

    def sums(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        rows = chunk["docs"].combine_chunks().flatten()
        place, held = pairs["place"].to_numpy(), np.zeros(len(pairs), np.int64)
        held[place] = pairs["documents"].to_numpy()
        best = np.zeros(len(pairs), np.int64)
        best[place] = pairs["best"].combine_chunks().cast(pa.int64()).to_numpy() if len(pairs) else 0
        places, times = (np.frombuffer(chunk[c][0].as_py(), "<i4").astype(np.int64) for c in ("places", "times"))
        ends = np.concatenate([[0], np.cumsum(rows.field("pairs").to_numpy())])

        def per_document(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

        made = [rows.field(n) for n in names]
        made += [pa.array(per_document(times * best[places])), pa.array(per_document(times * held[places]))]
        return pa.Table.from_arrays(made, names=[*names, "n_best", "count_sum"])

    documents = documents.select("chunk", "docs", "places", "times")
    return documents.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(
        sums, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
