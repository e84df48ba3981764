"""Token ids in files of bit planes.

Ids of documents in ascending id order are cut into blocks of BLOCK ids. A block is transposed into one plane per bit of
its largest id (bit j of all its ids, packed eight to a byte) or one per byte, and each plane is compressed with zstandard on
its own. A file is a Parquet table of blocks, so that any store Spark writes can hold it: part, block, number of ids, the planes,
and the block's chunk index: for each document with ids in it, its number in the part, its id, and how many of its
ids stand here. A document may span blocks; blocks are read independently of each other.

Rows are dealt out by ranges of the id and sorted within, so a part is a task's range and no part grows with the
input; the first id of a part is the sum of the parts before (one row per part). Null texts count as empty: they hold the end id
only. Null ids come first. Rows of one id follow each other in the order of their texts' checksums.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm.common import documents_of, pieces, shared_folder, texts_of
from tributary.llm.cross_tokenizer import byte_characters

BLOCK, LEVEL, CACHE = 65_536, 3, 1_000_000
#: Fixed value: the pattern for which words are put together from runs of letters and of marks.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A run of lower-case Latin letters and a run of marks but for the apostrophe.
SIMPLE = re.compile(r"([a-z\u00DF-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")
PIECE = pa.struct([("doc", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("here", pa.int64())])
ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("planes", pa.list_(pa.binary())), ("index", pa.list_(PIECE))])
FILE = """part long, block long, n long, planes array<binary>,
    index array<struct<doc: long, doc_id: long, begin: long, n_tokens: long, here: long>>"""


def to_planes(ids: np.ndarray, plane: str = "bit") -> list[bytes]:
    """The planes of ids below 2**32, lowest first; zeros beyond the largest id's width are left out."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    if plane == "byte":
        return [pack(np.ascontiguousarray(c)) for c in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: -(-bits // 8)]]
    return [pack(np.packbits((ids >> np.uint32(j)).astype(np.uint8) & 1)) for j in range(bits)]


def from_planes(planes: list[bytes], n: int, plane: str = "bit") -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    ids = np.zeros(n, np.uint32)
    for j, packed in enumerate(planes):
        raw = np.frombuffer(unpack(packed), np.uint8)
        ids |= raw.astype(np.uint32) << np.uint32(8 * j) if plane == "byte" else np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(j)
    return ids


class Words:
    """Ids of texts from the tokenizers library, which drops white space and never joins what it separates: the library
    encodes each new word between white space once, and texts are put together from their words' ids.

    Memory is bounded: the first CACHE words stay known, words beyond them are encoded anew in each batch.
    The library lower-cases, so A to Z are lower-cased beforehand where that leaves the text in normal form C and makes no
    special token of it. Where its pattern makes a piece of a run of letters and one of a run of marks, a word of lower-case Latin
    letters and marks goes to the library's model piece by piece, without the normalizer and the pattern, which change nothing there.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        model, parts = Tokenizer.from_str(tokenizer), json.loads(tokenizer)
        self.encode, self.model = model.encode_batch_fast, model.model
        self.fold = "Lowercase" in str(parts.get("normalizer"))
        self.special = [t["content"].lower().encode() for t in parts.get("added_tokens", ())]
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_piece = self.fold and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == PIECES
        self.spelled = {b: c for c, b in byte_characters().items()}
        self.known: dict[bytes, bytes] = {}

    def split(self, text: str) -> list[bytes]:
        raw = text.encode()
        if self.fold:
            low = raw.lower()
            plain = text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low.decode())
            if plain and not any(s in low for s in self.special):
                raw = low
        return raw.split()

    def piece(self, piece: bytes) -> bytes:
        """Ids of a run of letters or marks, from the library's model."""
        found = self.known.get(piece)
        if found is None:
            text = piece.decode() if piece.isascii() else "".join(map(self.spelled.__getitem__, piece))
            found = self.known[piece] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return found

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words beside the known ones."""
        rest, known, simple = [], self.known, SIMPLE.fullmatch
        for word in words:
            found = self.by_piece and simple(word.decode())
            if found:
                stem, marks = found.groups()
                known[word] = self.piece(stem.encode()) + (self.piece(marks.encode()) if marks else b"")
            else:
                rest.append(word)
        for i in range(0, len(rest), 10_000):
            some = rest[i : i + 10_000]
            for word, e in zip(some, self.encode([w.decode() for w in some], add_special_tokens=False)):
                known[word] = array("I", e.ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known = self.known
        get, before = known.get, len(known)
        split = [self.split(t) for t in texts]
        found = [list(map(get, x)) for x in split]
        self.learn(list({w for x, y in zip(split, found) if None in y for w, f in zip(x, y) if f is None}))
        out = [b"".join([f or known[w] for w, f in zip(x, y)] if None in y else y) for x, y in zip(split, found)]
        if len(known) > CACHE:
            for word in list(islice(known, max(CACHE, before), None)):
                del known[word]
        return out


@lru_cache(maxsize=1)
def loaded(tokenizer: str) -> Words:
    """Built once per worker process, which serves many tasks."""
    return Words(tokenizer)


def blocks(docs: Iterator[tuple[int | None, np.ndarray]], part: int, plane: str) -> Iterator[pa.RecordBatch]:
    """Rows of the file from (id, ids) of the part's documents."""
    held: list[np.ndarray] = []
    index: list[dict] = []
    size = block = place = 0

    def row() -> pa.RecordBatch:
        ids = np.concatenate([np.zeros(0, np.uint32), *held])
        values = [part, block, len(ids), to_planes(ids, plane), index]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, ARROW)], schema=ARROW)

    for number, (name, ids) in enumerate(docs):
        entry = {"doc": number, "doc_id": name, "begin": place, "n_tokens": len(ids)}
        place += len(ids)
        while True:
            here = ids[: BLOCK - size]
            held.append(here)
            index.append(entry | {"here": len(here)})
            size, ids = size + len(here), ids[len(here) :]
            if size == BLOCK:
                yield row()
                held, index, size, block = [], [], 0, block + 1
            if not len(ids):
                break
    if index:
        yield row()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, plane: str = "bit",
          doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes the ids of all documents, each with the end id, to the folder ``path`` and returns it. ids are 64-bit integers."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, whatever the data
    ordered = documents_of(docs, doc_id, text).withColumn("crc", F.crc32(F.encode("text", "UTF-8")))
    ordered = ordered.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(model.value)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        def each():
            for batch in pieces(batches):
                for name, ids in zip(batch.column(0).to_pylist(), words.ids(texts_of(batch))):
                    yield name, np.frombuffer(ids + end, "<u4")

        yield from blocks(each(), TaskContext.get().partitionId(), plane)

    ordered.select("doc_id", "text").mapInArrow(run, FILE).write.option("compression", "uncompressed").mode("overwrite").parquet(path)
    return path


def read(spark, path: str, plane: str = "bit", digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """One row per piece of a document: part, block, doc (its number in the part), doc_id, begin (its first id's place in the
    part), n_tokens (of the whole document), here (of the piece), and the piece's ids or, with ``digest``, their checksum as value."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), *PIECE, ("ids", pa.list_(pa.int64())) if digest is None else ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n"], plane)
                rows, at = row["index"], 0
                for entry in rows:
                    mine = ids[at : at + entry["here"]]
                    at += len(mine)
                    entry |= {"part": row["part"], "block": row["block"]}
                    entry |= {"ids": mine.astype(np.int64)} if digest is None else {"value": digest(mine)}
                yield pa.RecordBatch.from_pylist(rows, schema)

    made = "ids array<long>" if digest is None else "value long"
    columns = f"part long, block long, doc long, doc_id long, begin long, n_tokens long, here long, {made}"
    return spark.read.schema(FILE).parquet(path).mapInArrow(run, columns)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def joined_crc(crcs: list[int], lengths: list[int]) -> int:
    """crc32 of pieces in a row from theirs: zeros are run through the register by squaring its matrix."""

    def times(matrix, vector):
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return out

    total = crcs[0]
    for crc, length in zip(crcs[1:], lengths[1:]):
        matrix = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
        n = 8 * length
        while n:
            if n & 1:
                total = times(matrix, total)
            matrix = [times(matrix, m) for m in matrix]
            n >>= 1
        total ^= crc
    return total


def pieces_crc(found) -> int:
    found = sorted(found, key=lambda x: x["block"])
    return joined_crc([x["value"] for x in found], [4 * x["here"] for x in found])


def contents(spark, path: str, plane: str = "bit") -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    A document's pieces, one per block it stands in, meet by (part, doc); their checksums are joined.
    """
    base = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    docs = read(spark, path, plane, checksum).groupBy("part", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("begin").alias("begin"), F.first("n_tokens").alias("n_tokens"),
        F.collect_list(F.struct("block", "here", "value")).alias("found"),
    )
    docs = docs.join(base, "part")
    joined = F.udf(pieces_crc, "long", useArrow=True)
    return docs.select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", joined("found").alias("ids_crc32"))


def shared_path(docs: DataFrame) -> str:
    """A new folder for files beside the checkpoints."""
    return f"{shared_folder(docs)}/ids-{uuid.uuid4().hex}"
