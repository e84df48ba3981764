"""A corpus from documents: toxic ones out, one of each near-duplicate group, personal data replaced, sources mixed, tokens.

Each stage reads all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import byte_bpe, mixing, pii, simhash_similar, toxicity
from tributary.llm.common import shared_folder, table


#: Rows and bytes of an Arrow batch. Spark's own 10,000 rows and 64 MB of texts are held several times over by the JVM, outside its
#: heap, and by each Python worker, and neither gives all of it back.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage in batches of at most ``BATCH``. They stay set, since a stage's rows are made when the caller writes them."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCH.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model fitted to the labels does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.accepted(F.col("text"), model, spark))


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints at two bits or fewer, and sets of five words at 0.8 or more."""
    return simhash_similar.one_per_group(docs, bits=2)


@in_small_batches
def drop_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = docs.withColumn("text", pii.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


@in_small_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the decoded ids are the text again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.encode(
        docs.select(F.struct("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")).alias("key"), "text"),
        path, public_tokenizers.PATTERN, decode=True, doc_id="key",
    )
    return tokens.select(
        "doc_id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.crc32("decoded") == F.col("doc_id.crc")).alias("lossless")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("personal_data", drop_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: No SQL: fitted model, XXH64 and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(docs)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
