"""Mixing sources to target weights by pivotal dependent rounding.

Sources get weights by rank and share ``share`` of all sizes; no source gets more than ``most`` times its own size,
what is above goes to the others by weight until none is above. A source's documents then all have the same
fractional number of copies, target / size. Their whole part is taken at once; the fractions are rounded
dependently: two documents meet, words move from one to the other until one of them has a whole number of copies,
and which of the two gives is drawn so that every expected number of copies stays as it was. The words of the pair
together never change, so a group of documents ends with one fractional document at most, and its sum of words is exact.

A group is a source, a size class (power of two) and one of its buckets; a source or class with many documents has many
buckets, and rows of one id are numbered and dealt like others, so no task gets a group of more than about BUCKET rows. The documents left over go up a reduction tree, FAN
buckets at a time, until each source and class has one; a source's last ones (one per class, largest first)
are rounded so that their sum comes nearest to what is left. All draws are hashes of the documents' ids.

Null sources are one source, the last; null texts have size 0; null and empty ids are two ids. A document without words gets its rounded copies
and takes no words. Rows that agree in id, source and size are interchangeable. Empty tables give empty tables.
"""

from __future__ import annotations


import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import n_words, settled

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BUCKET, FAN = 4096, 1024
ROWS = "doc_id string, source string, tie long, size long, ratio double, class int, bucket long, part double, copies long"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, ratio) per source of (source, size).

    The level up to which sources fill by weight solves sum(min(most * size, level * weight)) = share * sum(size): sources
    are put in order of most * size / weight, and those before the first that is not full are full. The windows run
    over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = by.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by = (
        by.withColumn("before", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(every) - F.col("before")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return by.select(
        "source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("ratio")
    )


def draw(seed: int, *ids) -> float:
    return xxhash.xxh64_intdigest(repr(ids), seed) / 2.0**64


def pivot(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One pass over the rows: part and copies as they are after it; one row at most keeps a part."""
    rows = rows.sort_values(["size", "doc_id", "tie"], ascending=[False, True, True], kind="stable")
    ids, sizes = rows["doc_id"].tolist(), rows["size"].tolist()
    ties, part, copies = rows["tie"].tolist(), rows["part"].tolist(), rows["copies"].tolist()

    def whole(i: int, up: bool) -> None:
        part[i], copies[i] = 0.0, copies[i] + up

    held = None
    for i, p in enumerate(part):
        if not 1e-9 < p < 1 - 1e-9:
            whole(i, p > 0.5)
        elif sizes[i] == 0:
            whole(i, draw(seed, ids[i], ties[i]) < p)
        elif held is None:
            held = i
        else:
            mine, other = part[held] * sizes[held], p * sizes[i]
            give = min(mine, sizes[i] - other)  # words that can go from the held one to this one
            take = min(sizes[held] - mine, other)
            goes = draw(seed, ids[held], ties[held], ids[i], ties[i]) * (give + take) < take
            moved = -give if goes else take
            part[held], part[i] = (mine + moved) / sizes[held], (other - moved) / sizes[i]
            for k in (held, i):
                if not 1e-9 < part[k] < 1 - 1e-9:
                    whole(k, part[k] > 0.5)
            held = held if part[held] else i if part[i] else None
    return rows.assign(part=part, copies=copies)


def last(rows: pd.DataFrame) -> pd.DataFrame:
    """A source's last documents, largest first, each rounded to what is left of the words so far."""
    rows = rows.sort_values(["size", "doc_id", "tie"], ascending=[False, True, True], kind="stable")
    left, copies = 0.0, rows["copies"].tolist()
    for i, (size, p) in enumerate(zip(rows["size"].tolist(), rows["part"].tolist())):
        up = size > 0 and p * size + left >= size / 2
        left += p * size - up * size
        copies[i] += up
    return rows.assign(part=0.0, copies=copies)


def bucketed(rows: DataFrame, numbered: bool, seed: int) -> DataFrame:
    """The rows with their class and bucket; rows that agree in id, source and size are numbered unless ``tie`` does it."""
    rows = rows.withColumn("class", F.coalesce(F.floor(F.log2(F.col("size"))), F.lit(-1)).cast("int"))
    counts = rows.groupBy("source", "class").agg(F.ceil(F.count("*") / F.lit(BUCKET)).cast("long").alias("buckets"))
    counts = counts.select(F.col("source").alias("of"), F.col("class").alias("in"), "buckets")
    place = F.col("tie")
    if not numbered:
        same = Window.partitionBy("doc_id", "source", "tie", "size").orderBy(F.lit(0))
        place, rows = F.col("tie") + F.col("nth") - 1, rows.withColumn("nth", F.row_number().over(same))
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("in")))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", place.cast("long"), F.lit(seed)), "buckets"))


def marked(text: Column) -> Column:
    """Ids without nulls: null is the empty text, and an empty id, or one that begins with NUL, gets a NUL before it."""
    nul = F.lit("\0")
    return F.when(text.isNull(), F.lit("")).when((text == "") | text.startswith(nul), F.concat(nul, text)).otherwise(text)


def unmarked(text: Column) -> Column:
    return F.when(text.startswith(F.lit("\0")), F.substr(text, F.lit(2))).when(text != "", text)


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, tie: Column | None = None,
            weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 8) -> DataFrame:
    """One row per document: doc_id, source, tie, size, source_size, target, copies.

    ``size`` is the words of column text unless given; ``tie`` tells rows of one id apart (0 unless given).
    """
    size = n_words(F.col("text")) if size is None else size
    narrow = settled(
        docs.select(
            marked(F.col(doc_id).cast("string")).alias("doc_id"), F.col(source).cast("string").alias("source"),
            (F.lit(0) if tie is None else tie).cast("long").alias("tie"), size.cast("long").alias("size"),
        )
    )
    shares = settled(targets(narrow, weights, share, most))
    # One row per source: as many as sources, so an ordinary join that adaptive execution may broadcast.
    rows = narrow.join(shares.select("source", "ratio").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = settled(bucketed(rows, tie is not None, seed))
    most_buckets = rows.agg(F.max("buckets")).first()[0] or 1
    rows = rows.select(
        "doc_id", "source", "tie", "size", "ratio", "class", "bucket",
        (F.col("ratio") - F.floor("ratio")).alias("part"), F.floor("ratio").cast("long").alias("copies"),
    )

    def step(group: pd.DataFrame) -> pd.DataFrame:
        return pivot(group, seed)

    done, level = [], rows
    while True:
        level = settled(level.groupBy("source", "class", "bucket").applyInPandas(step, ROWS))
        done.append(level.where("part = 0"))
        level = level.where("part > 0")
        if most_buckets <= 1:
            break
        most_buckets = -(-most_buckets // FAN)
        level = level.withColumn("bucket", F.floor(F.col("bucket") / FAN))
    out = level.groupBy("source").applyInPandas(last, ROWS)
    for rows in done:
        out = out.union(rows)
    shares = shares.withColumnRenamed("source", "of")
    kind = docs.schema[doc_id].dataType
    out = out.withColumn("doc_id", unmarked(F.col("doc_id")).cast(kind))
    return out.join(shares, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "tie", "size", "source_size", "target", "copies")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it.

    Rows that agree in id and text are told apart by number, so every row gets its own copies.
    """
    names = docs.columns
    same = Window.partitionBy("_hash").orderBy("_id", "_size")
    keyed = docs.select(
        F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(doc_id, text, "source").alias("_hash"),
        F.col("source").alias("_source"), n_words(F.col(text)).alias("_size"),
    )
    keyed = keyed.withColumn("_nth", F.row_number().over(same))
    marks = mixture(keyed.select("_hash", "_source", "_size", "_nth"), "_hash", "_source", F.col("_size"), F.col("_nth"))
    marks = marks.where("copies > 0").select(F.col("doc_id").alias("_mark"), F.col("tie").alias("_mark_nth"), "copies")
    # The number is a join key: n rows of one hash meet n marks in n pairs.
    joined = keyed.join(marks, (F.col("_hash") == F.col("_mark")) & (F.col("_nth") == F.col("_mark_nth")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("_row")[n].alias(n) for n in names])
