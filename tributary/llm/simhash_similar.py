"""Near-duplicates at a Jaccard similarity of distinct shingles: a prefix index without misses, and exact verification.

A document is its set of distinct shingle hashes (repeats do not count). In any fixed order of the shingles, two sets x and y of
similarity t or more share a shingle among the first |x| - ceil(t |x|) + 1 of x and the first |y| - ceil(t |y|) + 1 of y, so an
index of these prefixes misses no pair. The order is rare shingles by hash, then those that a sample of 1 in SAMPLE texts
holds SEEN times or more, most frequent last: a common line or passage is in a prefix only where a text has little else.
The sample decides how long postings get, never which pairs are found.

A pair that meets is first held against two exact bounds: the sizes, and the parities of the hashes in twice as many cells
as there are shingles, 1,024 at least (each cell that differs is a shingle that only one of the two has). What passes is verified: the two texts' sets
are made again and the share of common shingles is counted. Only pairs of t or more are linked; groups are components.

Postings of at most SMALL sets form all their pairs. In a larger one every set is compared with the smallest, and where it then
still holds several components, its sets are compared tile by tile: first by the bounds, which leaves the sets that are near one of
another component, then these by the count (at most about two tiles per task), and only a spanning forest leaves the task; postings and tiles of the same sets count once. So rows stay in
proportion to the postings. Equal sets are one row of the index; sets and shingles are known by 64-bit hashes.

Words are those of ``simhash``: a text shorter than ``width`` words is one shingle, texts without words have the empty set and are
one group. Null texts count as empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import documents_of, free, pieces, settled, texts_of
from tributary.llm.components import components
from tributary.llm.embedding_dedup import Forest
from tributary.llm import simhash
from tributary.llm.simhash import shingle_hashes

CELLS, SMALL, TILE = 1024, 8, 1024
#: One text in SAMPLE is counted; shingles that SEEN or more of them hold come last, MOST of them at most.
SAMPLE, SEEN, MOST = 16, 3, 100_000
#: Narrow rows (a 64-bit key or two) that a broadcast takes at most; beyond, the side is shuffled.
FEW = 2_000_000
#: Sets that a task remembers.
KNOWN = 500_000
#: Rows of an Arrow batch here.
BATCH = 1000


def shingle_set(text: str, width: int, seed: int) -> np.ndarray:
    """The text's distinct shingle hashes in order."""
    found = list(shingle_hashes(text, width, seed))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def parities(hashes: np.ndarray) -> bytes:
    """Whether each cell of the hashes holds an odd number of them; a power of two of cells, at least two per hash."""
    cells = max(CELLS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else CELLS
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The parities in fewer cells: half of them laid upon the other half."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Cells whose parities differ: two sets differ in as many shingles at least."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(dtype=np.int64))


def most_apart(similarity: float) -> float:
    """Of |a| + |b|, the share of shingles that only one of a similar pair has."""
    return (1 - similarity) / (1 + similarity)


class Summaries:
    """Sizes and parities of some sets."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes], similarity: float):
        self.sizes, self.similarity, self.most = sizes, similarity, most_apart(similarity)
        self.bits = [np.frombuffer(x, np.uint64) for x in bits]
        self.short = np.array([folded(x, CELLS // 64) for x in self.bits])

    def near(self, x: int, y: np.ndarray) -> Iterator[int]:
        """Those of y that the bounds leave as similar to x."""
        y = y[np.minimum(self.sizes[y], self.sizes[x]) >= self.similarity * np.maximum(self.sizes[y], self.sizes[x]) - 1e-6]
        limit = self.most * (self.sizes[y] + self.sizes[x]) + 1e-6
        close = np.bitwise_count(self.short[y] ^ self.short[x]).sum(1, dtype=np.int64) <= limit
        return (k for k, n in zip(y[close].tolist(), limit[close].tolist()) if apart(self.bits[x], self.bits[k]) <= n)


def prefix(hashes: np.ndarray, last: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, those in ``last`` (sorted, with their ranks) after all others."""
    n = len(hashes)
    size = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not len(last):
        return hashes[:size]
    at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
    late = last[at] == hashes
    return np.concatenate([hashes[~late], hashes[late][np.argsort(rank[at[late]])]])[:size]


def frequent(docs: DataFrame, width: int, seed: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come last: sorted hashes, and each one's rank by frequency."""
    some = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for t in texts_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, width, seed).view(np.int64))], ["hash"])

    counted = some.mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    found = [r.hash for r in counted.orderBy(F.desc("n"), "hash").limit(MOST).collect()]  # at most MOST numbers
    hashes = np.array(found[::-1], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def summaries(docs: DataFrame, width: int, similarity: float, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text's hash, fp (the set's hash), n (its size), bits (parities), first (its prefix; empty
    where the task has given that of an equal set, of which it remembers KNOWN, so copies do not pile up in postings)."""
    last, rank = frequent(docs, width, seed, text)
    source = documents_of(docs, doc_id, text).withColumn("hash", F.xxhash64("text"))
    names, longs = ["doc_id", "hash", "fp", "n", "bits", "first"], pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def new(fp: int) -> bool:
            if fp in seen:
                return False
            if len(seen) < KNOWN:
                seen.add(fp)
            return True

        for batch in pieces(batches):
            sets = [shingle_set(t, width, seed) for t in texts_of(batch)]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
            bits = pa.array([parities(s) for s in sets], pa.binary())
            first = pa.array([prefix(s, last, rank, similarity).view(np.int64) if new(fp) else () for s, fp in zip(sets, fps.tolist())], longs)
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps), sizes, bits, first], names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, hash long, fp long, n int, bits binary, first array<long>")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside: a row may hold a text or two sets, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few(rows: DataFrame, bound: int) -> bool:
    """Whether there are at most so many rows, so that a side of narrow rows may be broadcast."""
    return rows.limit(bound + 1).count() <= bound


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, seed: int, text: str = "text", bound: int = FEW) -> DataFrame:
    """(fp, shingles) of the texts whose hash is in ``wanted``; shingles are sorted 64-bit numbers.

    Up to ``bound`` hashes are broadcast, so that only wanted texts are shuffled; beyond, one of each text per task is.
    """
    wanted = wanted.select(F.col("hash").alias("_hash"))
    texts = docs.select(F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    broadcast = few(wanted, bound)
    if broadcast:
        texts = texts.join(F.broadcast(wanted), "_hash", "left_semi")
    texts = texts.withColumn("_nth", F.row_number().over(Window.partitionBy("_hash").orderBy(F.lit(0)))).where("_nth = 1")
    if not broadcast:
        texts = texts.join(wanted, "_hash", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shingle_set(t, width, seed).tobytes() for t in texts_of(batch)]
            fps = np.array([xxhash.xxh64_intdigest(s, seed) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(found, pa.binary())], ["fp", "shingles"])

    return texts.select("text").mapInArrow(run, "fp long, shingles binary")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, large) from postings in order of key and set: all pairs of small postings, and for large ones each
    set with the posting's first. Repeated rows count once."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_key = leader = last = None  # of a large posting that goes on; the row before

    def rows(key, a, b, large):
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(np.full(n, large))], ["key", "a", "b", "large"])

    def out(keys, fps):
        begins = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1) != 0) if len(keys) else np.zeros(0, np.int64)
        length = np.repeat(np.diff(begins, append=len(keys)), np.diff(begins, append=len(keys)))
        first = np.repeat(begins, np.diff(begins, append=len(keys)))
        some = np.flatnonzero((length > SMALL) & (first != np.arange(len(keys))))
        if len(some):
            yield rows(keys[some], fps[first[some]], fps[some], True)
        left = np.flatnonzero((length > 1) & (length <= SMALL))
        for d in range(1, SMALL):
            left = left[left + d < len(keys)]
            left = left[keys[left] == keys[left + d]]
            if not len(left):
                break
            yield rows(keys[left], fps[left], fps[left + d], False)

    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        other = np.ones(len(k), bool)
        other[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
        if len(k):
            other[0] = (k[0], f[0]) != last
            last = k[-1], f[-1]
        k, f = k[other], f[other]
        if open_key is not None:
            n = int(np.searchsorted(k, open_key, "right"))
            if n:
                yield rows(k[:n], np.full(n, leader), f[:n], True)
            if n == len(k):
                continue
            k, f, open_key = k[n:], f[n:], None
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if len(keys) - cut > SMALL:
            open_key, leader, cut = keys[-1], fps[cut], len(keys)
        yield from out(keys[:cut], fps[:cut])
        keys, fps = keys[cut:], fps[cut:]
    yield from out(keys, fps)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the two sorted sets have this share of common shingles, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= similarity


def numbers_of(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit numbers in each value of a binary column, without copies."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [flat[a:b].view(np.uint64) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def bounded(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The rows (a, b) of (a, b, sum of the sizes, a_bits, b_bits) whose parities may be those of similar sets."""
    most = most_apart(similarity)
    for batch in batches:
        bits = [numbers_of(batch.column(i)) for i in (3, 4)]
        kept = [apart(x, y) <= most * n + 1e-6 for n, x, y in zip(batch.column(2).to_pylist(), *bits)]
        yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The rows (a, b) of (a, b, a_set, b_set) that are similar."""
    for batch in batches:
        sets = [numbers_of(batch.column(i)) for i in (2, 3)]
        kept = pa.array([alike(x, y, similarity) for x, y in zip(*sets)], pa.bool_())
        yield batch.select([0, 1]).filter(kept)


def near_links(docs: DataFrame, fps: DataFrame, postings: DataFrame, width: int, similarity: float, seed: int, text: str = "text") -> DataFrame:
    """Links (a, b) of column fp whose components are those of all pairs of this similarity or more. ``postings``: (key, fp)."""
    ordered = postings.repartition("key").sortWithinPartitions("key", "fp")
    found = settled(ordered.mapInArrow(met, "key long, a long, b long, large boolean"))
    one, other = (fps.select(F.col("fp").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-6
    pairs = pairs.join(one, "a").join(other, "b").where(sizes).select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), "a_bits", "b_bits")
    pairs = settled(pairs.mapInArrow(lambda batches: bounded(batches, similarity), "a long, b long"))

    def sets(nodes: DataFrame) -> DataFrame:
        return settled(sets_of(docs, nodes.distinct().join(fps, "fp").select("hash"), width, seed, text))

    known = sets(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")))
    mine, theirs = (known.select(F.col("fp").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    both = pairs.join(mine, "a").join(theirs, "b").select("a", "b", "a_set", "b_set")
    links = settled(both.mapInArrow(lambda batches: verified(batches, similarity), "a long, b long"))
    free(pairs, known)

    large = found.where("large")
    members = large.select("key", F.col("b").alias("fp")).union(large.select("key", F.col("a").alias("fp")).distinct())
    if members.isEmpty():
        return links
    roots = components(links).withColumnRenamed("node", "fp")
    members = members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    split = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.bit_xor(F.xxhash64("fp")).alias("one"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("two"),
    ).where("lo != hi").groupBy("n", "one", "two").agg(F.min("key").alias("key"))  # postings of the same sets count once
    split = split.select("key", F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("tiles"))
    dealt = members.join(split, "key").withColumn("t", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    dealt = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = settled(dealt.select("key", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "fp", "root"))
    if dealt.isEmpty():
        return links
    place = ["key", "i", "j"]

    def sides(group: pd.DataFrame) -> tuple[pd.DataFrame, int]:
        """The rows of the first tile, then those of the second (the same ones again where it is the first), and where they begin."""
        mine, theirs = group[group["t"] == group["i"].iat[0]], group[group["t"] == group["j"].iat[0]]
        return pd.concat([mine, theirs], ignore_index=True), len(mine)

    def screen(group: pd.DataFrame) -> pd.DataFrame:
        rows, n = sides(group)
        summary = Summaries(rows["n"].to_numpy(), rows["bits"].tolist(), similarity)
        root, near = rows["root"].to_numpy(), np.zeros(len(rows), bool)
        for x in range(n if n < len(rows) else 0):
            y = list(summary.near(x, n + np.flatnonzero(root[n:] != root[x])))
            near[y] = True
            near[x] |= bool(y)
        return rows.loc[near, [*place, "fp"]].drop_duplicates()

    screened = dealt.join(fps.select("fp", "n", "bits"), "fp").groupBy(*place).applyInPandas(screen, "key long, i int, j int, fp long")
    screened = settled(dealt.join(screened, [*place, "fp"]))
    free(dealt, found)
    dealt = screened
    if dealt.isEmpty():
        return links
    side = ["fp", F.col("t") == F.col("i"), F.col("i") == F.col("j")]
    once = dealt.groupBy(*place).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*side)).alias("one"), F.bit_xor(F.xxhash64(*side, F.lit(1))).alias("two"))
    once = once.groupBy("n", "one", "two").agg(F.min(F.struct(*place)).alias("place")).select("place.*")  # tiles of the same sets count once
    once = settled(dealt.join(once, place))
    free(dealt)
    dealt = once

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        rows, n = sides(group)
        summary = Summaries(rows["n"].to_numpy(), rows["bits"].tolist(), similarity)
        held, fp = [np.frombuffer(x, np.uint64) for x in rows["shingles"]], rows["fp"].to_numpy()
        _, at = np.unique(rows["root"].to_numpy(), return_inverse=True)
        forest, a, b = Forest(at.max() + 1), [], []
        for x in range(n if n < len(rows) else 0):
            for k in summary.near(x, n + np.flatnonzero(forest.root[at[n:]] != forest.root[at[x]])):
                if forest.root[at[k]] != forest.root[at[x]] and alike(held[x], held[k], similarity):
                    a.append(fp[x])
                    b.append(fp[k])
                    forest.add(at[x : x + 1], at[k : k + 1])
        return pd.DataFrame({"a": a, "b": b})

    dealt = dealt.join(fps.select("fp", "n", "bits"), "fp").join(sets(dealt.select("fp")), "fp")
    return links.union(dealt.groupBy(*place).applyInPandas(compare, "a long, b long"))


def grouped(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and root, the same for all documents of a group."""
    with batches_of(docs.sparkSession, BATCH):
        rows = settled(summaries(docs, width, similarity, seed, doc_id, text))
        fps = settled(rows.select("fp", "hash", "n", "bits").dropDuplicates(["fp"]))
        postings = rows.select(F.explode("first").alias("key"), "fp")
        roots = components(near_links(docs, fps, postings, width, similarity, seed, text)).withColumnRenamed("node", "fp")
    free(fps)
    return rows.join(roots, "fp", "left").select("doc_id", F.coalesce("root", "fp").alias("root"))


def joined_by_fingerprints(found: DataFrame, docs: DataFrame, bits: int, seed: int) -> DataFrame:
    """``grouped``'s rows, groups that hold documents whose SimHash fingerprints link (``simhash.grouped``) made one.

    ``doc_id`` is a struct that holds the text's ``hash``. The links are between groups: one row per group and fingerprint group.
    """
    near = simhash.grouped(docs, bits=bits, seed=seed, doc_id="_key", text="_text").select(F.col("doc_id.hash").alias("hash"), F.col("root").alias("near"))
    sides = found.select(F.col("doc_id.hash").alias("hash"), "root").distinct().join(near.distinct(), "hash").select("root", "near").distinct()
    lowest = sides.groupBy("near").agg(F.min("root").alias("low"), F.count("*").alias("n")).where("n > 1")
    roots = components(sides.join(lowest, "near").select(F.col("root").alias("a"), F.col("low").alias("b"))).toDF("root", "_low")
    return found.join(roots, "root", "left").select("doc_id", F.coalesce("_low", "root").alias("root"))


def one_per_group(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, doc_id: str = "doc_id", text: str = "text",
                  bound: int = FEW, bits: int | None = None) -> DataFrame:
    """One document of each group, the one of smallest id (by content where ids repeat, null ids last), with all its columns.

    With ``bits``, documents whose SimHash fingerprints (of ``simhash``, repeats included) differ in so few bits are of one group as well.

    The choice is made on narrow rows. Up to ``bound`` rows that go, and ids and contents that come several times, are broadcast, and
    only rows of the latter are shuffled; beyond, whole rows are shuffled once, by id and content, after at most
    one of each such pair per task is left. Documents without words are one group.
    """
    names = docs.columns
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")).alias("_key")
    keyed = docs.select(key, F.col(text).alias("_text"))
    found = grouped(keyed, width, similarity, seed, "_key", "_text")
    if bits is not None:
        found = joined_by_fingerprints(settled(found), keyed, bits, seed)
    found = found.groupBy("root", F.col("doc_id.id").alias("id"), F.col("doc_id.hash").alias("hash")).agg(F.count("*").alias("n"))
    found = settled(found)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("hash").alias("hash"))).alias("best"))
    chosen = found.join(best, "root").select(
        F.xxhash64("id", "hash").alias("_key"), "n", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("hash") == F.col("best.hash"))).alias("_kept"),
    )
    chosen = settled(chosen)
    free(found)

    def first_of_each(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))).where("_nth = 1")

    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(doc_id), F.xxhash64(text)).alias("_key"))
    other = chosen.where("not _kept or n > 1").select("_key", "_kept")
    if few(other, bound):
        marked = rows.join(F.broadcast(other), "_key", "left")
        rows = marked.where("_kept is null").select("_row").union(first_of_each(marked.where("_kept")).select("_row"))
    else:
        rows = first_of_each(rows).join(chosen.where("_kept"), "_key", "left_semi")
    return rows.select(*[F.col("_row")[n].alias(n) for n in names])
