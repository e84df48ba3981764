"""Sharding by fixed virtual slots.

Records are hashed into SLOTS virtual slots by id and content, the bytes of each slot are summed (combined before their shuffle), and
a map says which shard holds which slot. The map is a Parquet table of versions in a folder, read again by any later run:
version 0 deals the slots out in turn (``begin``), ``rebalance`` adds a version edited by moving single slots from the largest
shards to the smallest until their sizes are near equal, ``grow`` one that moves slots to one more shard only. Versions
are never changed, and records never change slots.

The map has SLOTS rows, so it is planned on the driver and broadcast; the records are not. Rows that agree in id and text
are numbered first, so that repeats spread over the slots as well. Null texts have no bytes and size 1, null ids are
a value like any other. An empty table gives an empty result and the first map.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import documents_of, settled, shared_folder

SLOTS = 4096
MAP = "slot int, shard int, bytes long"


def sized(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, nth, virtual_slot) per row; nth numbers the rows of one id and text."""
    rows = documents_of(docs, doc_id, text).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    same = Window.partitionBy("doc_id", "size", "text_crc32").orderBy(F.lit(0))
    rows = rows.withColumn("nth", F.row_number().over(same))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "nth"), F.lit(slots)).cast("int"))


def first_map(slots: int, shards: int) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def loads(placed: dict[int, int], sizes: dict[int, int], shards: int) -> list[int]:
    out = [0] * shards
    for slot, shard in placed.items():
        out[shard] += sizes.get(slot, 0)
    return out


def rebalanced(placed: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map: while it narrows the gap, the slot that best halves it goes from the largest shard to a smaller
    one, or two slots change places when no single slot does."""
    placed, load = dict(placed), loads(placed, sizes, shards)
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in placed.items():
        if sizes.get(slot, 0):
            held[shard].add(slot)
    for _ in range(8 * len(placed)):
        big, small = load.index(max(load)), load.index(min(load))
        gap = load[big] - load[small]
        moves = [(abs(gap - 2 * sizes[s]), sizes[s], s, None) for s in held[big] if sizes[s] < gap]
        best = min(moves, default=(gap, 0, None, None))
        if best[0] > gap * 0.2 and held[small]:
            small_sizes = sorted((sizes[s], s) for s in held[small])
            for s in held[big]:
                want = sizes[s] - gap / 2
                lo, hi = 0, len(small_sizes) - 1
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if small_sizes[mid][0] < want else (lo, mid)
                for size, other in small_sizes[max(0, lo - 1) : lo + 1]:
                    if 0 < (d := sizes[s] - size) < gap:
                        best = min(best, (abs(gap - 2 * d), d, s, other), key=lambda x: x[0])
        if best[2] is None or best[0] >= gap:
            break
        _, moved, slot, other = best
        held[big].remove(slot)
        held[small].add(slot)
        placed[slot] = small
        if other is not None:
            held[small].remove(other)
            held[big].add(other)
            placed[other] = big
        load[big] -= moved
        load[small] += moved
    return placed


def grown(placed: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """A map for one more shard, ``shards``: slots move to it, from the largest shard each time, and nowhere else."""
    placed, load = dict(placed), [*loads(placed, sizes, shards), 0]
    mean = sum(load) / (shards + 1)
    held = {s: sorted((sizes.get(slot, 0), slot) for slot, at in placed.items() if at == s) for s in range(shards)}
    while load[shards] < mean:
        giver = max(range(shards), key=load.__getitem__)
        fits = [x for x in held[giver] if x[0] and load[shards] + x[0] <= mean + x[0] / 2]
        if not fits:
            break
        size, slot = fits[-1]
        held[giver].remove((size, slot))
        placed[slot] = shards
        load[giver] -= size
        load[shards] += size
    return placed


def store_version(spark: SparkSession, folder: str, version: int, placed: dict[int, int], sizes: dict[int, int]) -> None:
    """Writes one version of the map; a version that is there is never written again."""
    rows = spark.createDataFrame([(slot, shard, sizes.get(slot, 0)) for slot, shard in sorted(placed.items())], MAP)
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def stored_map(spark: SparkSession, folder: str) -> DataFrame:
    """(version, slot, shard, bytes) of all versions in the folder."""
    return spark.read.schema(f"{MAP}, version int").parquet(folder).select("version", "slot", "shard", "bytes")


def latest(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """The newest version's number and its shard per slot: ``slots`` rows."""
    rows = stored_map(spark, folder)
    newest = rows.agg(F.max("version")).first()[0]
    return newest, {r["slot"]: r["shard"] for r in rows.where(F.col("version") == newest).collect()}


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}  # at most ``slots`` rows


def begin(rows: DataFrame, folder: str, shards: int, slots: int = SLOTS) -> int:
    """Stores version 0: the slots dealt out in turn."""
    store_version(rows.sparkSession, folder, 0, first_map(slots, shards), slot_bytes(rows))
    return 0


def rebalance(rows: DataFrame, folder: str) -> int:
    """Edits the newest version by the bytes the rows have in each slot, and stores the next one."""
    version, placed = latest(rows.sparkSession, folder)
    sizes = slot_bytes(rows)
    store_version(rows.sparkSession, folder, version + 1, rebalanced(placed, sizes, max(placed.values()) + 1), sizes)
    return version + 1


def grow(rows: DataFrame, folder: str) -> int:
    """Stores a version with one more shard, into which slots move from the others, and nowhere else."""
    version, placed = latest(rows.sparkSession, folder)
    sizes = slot_bytes(rows)
    store_version(rows.sparkSession, folder, version + 1, grown(placed, sizes, max(placed.values()) + 1), sizes)
    return version + 1


def shards_of(rows: DataFrame, placed: DataFrame, version: int) -> DataFrame:
    """The rows with shard and place: numbered from 0 within their shard without gaps.

    A place is the rows of the shard's slots before (a running count over the map) plus the place in the slot.
    """
    placed = placed.where(F.col("version") == version).select(F.col("slot").alias("virtual_slot"), "shard")
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(counts, "virtual_slot").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "nth")
    rows = rows.withColumn("within", F.row_number().over(within) - 1)
    return rows.join(F.broadcast(placed), "virtual_slot").withColumn("place", (F.col("before") + F.col("within")).cast("long"))


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text",
            folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, nth, virtual_slot, shard, place; shard sizes in bytes are near equal.

    The map is kept in ``folder`` (one of its own in the shared folder by default): begun there if the folder holds none,
    and edited by the documents' bytes.
    """
    rows = settled(sized(docs, slots, doc_id, text))
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_folder(docs)}/slot-map-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        begin(rows, folder, shards, slots)
    version = rebalance(rows, folder)
    return shards_of(rows, stored_map(spark, folder), version)
