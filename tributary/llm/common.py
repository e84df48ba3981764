"""Helpers shared by the operators: column choice, batches cut by bytes, and cut lineage."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at once.
CHUNK_CHARS = 2_000_000

#: White space of the contracts: blank, and the five controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def documents_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads; every other column, whatever its name, stays behind."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the folder in spark.checkpoint.dir, which every executor reaches; lineage ends there.

    Only a local session that names no folder gets one of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def free(*settled_rows: DataFrame) -> None:
    """Removes what ``settled`` wrote, once all that is made from it has been written itself."""
    for df in settled_rows:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let_go(df: DataFrame) -> None:
    """Spark removes shuffle files once the driver's JVM has collected what refers to them; in a loop of small jobs that may be never."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def shared_folder(df: DataFrame) -> str:
    """The folder behind ``settled``, as Spark names it; asks for it once so that it exists."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        settled(df.sparkSession.range(1))
    return context.getCheckpointDir()


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (one row at least), so that a worker's memory is bounded."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        if len(sizes) > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Null texts count as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def n_words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex64(bits: Column) -> Column:
    """A signed 64-bit column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
