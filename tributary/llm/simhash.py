"""SimHash near-duplicates by a byte-position index with count filtering.

A fingerprint is BYTES bytes at fixed positions. Two fingerprints that differ in at most d bits differ in at most d bytes,
so they share at least BYTES - d positional bytes. Postings of one byte would hold a 256th of the corpus each; as any two such
fingerprints also share at least two of d + 2 groups of neighbouring positions, the index keys a posting by the bytes
of two groups at once. The tally of shared positional bytes of each pair that meets in a posting is then
taken over all positions, pairs that reach the guaranteed minimum are kept, and their differing bits counted.

Only distinct fingerprints are indexed, so copies count once. Pairs are formed in postings of at most SMALL fingerprints.
A larger posting goes another, exact way without pairs: each of its fingerprints is put under itself and under every
fingerprint that differs from it in one bit (two of at most two bits' difference meet under one such key, and all that meet
under one differ in at most two bits); what meets is linked in a star. So a posting costs rows in proportion
to its size whatever its size is. Links become components by star contraction.

Words are lower-cased (A to Z) and split at white space; a shingle is ``width`` words joined by blanks, repeats included, or
the whole sequence when it is shorter. A bit of the fingerprint is 1 if it is set in more than half of the shingles' hashes.
Null and empty texts, and texts without words, have fingerprint zero and link like any other. Null ids link as well; a
component's id is its smallest id, null if none has one. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import documents_of, pieces, settled, texts_of
from tributary.llm.components import components

BYTES, SMALL, ROWS = 8, 64, 65_535


def shingle_hashes(text: str, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, in pieces of bounded length."""
    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends, n = ends[width - 1 :] if len(words) >= width else ends[-1:], max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, ROWS):
        cuts = zip(starts[k : k + ROWS].tolist(), ends[k : k + ROWS].tolist())
        found = [digest(joined[a:b], seed) for a, b in cuts]
        yield np.array(found, np.uint64)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (at most ROWS) have each of the 64 bits set, lowest first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    blocks = np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8)
    return blocks.sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash."""
    count, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        count += set_bits(hashes)
        total += len(hashes)
    return int(np.packbits(2 * count > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (long)."""
    source = documents_of(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [fingerprint(t, width, seed) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(bits: int) -> list[int]:
    """Masks over the positional bytes of two of bits + 2 groups each, signed."""
    cuts = np.linspace(0, BYTES, bits + 3).astype(int).tolist()
    group = [sum(0xFF << (8 * i) for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    both = [x | y for x, y in combinations(group, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def near_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct column fp that differ in at most ``bits`` bits."""
    if not 0 <= bits <= 2:
        raise ValueError("the way of large postings is exact for at most two bits")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(m).alias("mask")) for i, m in enumerate(masks(bits))]))
    postings = fps.select("fp", keys.alias("key")).select(
        F.col("key.k").alias("k"), F.col("fp").bitwiseAND(F.col("key.mask")).alias("value"), F.col("key.mask").alias("mask"), "fp"
    )
    sizes = postings.groupBy("k", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = settled(postings.join(sizes, ["k", "value"]))

    lists = met.where(F.col("n") <= SMALL).groupBy("k", "value").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = lists.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b")).where("a < b").distinct()
    other = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(BYTES))
    pairs = pairs.where((shared >= BYTES - bits) & (F.bit_count(other) <= bits))

    flips = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    large = met.where(F.col("n") > SMALL)
    near = large.select("k", "fp", F.explode(F.filter(flips, lambda f: f.bitwiseAND(F.col("mask")) == 0)).alias("flip"))
    if bits == 2:
        near = near.select("k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("under"))
    else:  # one bit apart: the two meet where one of them is itself
        low = F.least("fp", F.col("fp").bitwiseXOR(F.col("flip"))) if bits else F.col("fp")
        near = near.select("k", "fp", low.alias("under"))
    stars = near.distinct().groupBy("k", "under").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b")
    return pairs.union(stars)


def grouped(docs: DataFrame, width: int = 3, bits: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, root (the component's smallest fingerprint), component_id (its smallest id)."""
    rows = settled(fingerprints(docs, width, seed, doc_id, text))
    fps = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(fps.select("fp"), bits)).withColumnRenamed("node", "fp")
    fps = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = fps.groupBy("root").agg(F.min("first").alias("component_id"))
    fps = fps.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(fps, "fp").select("doc_id", "fp", "root", "component_id")
