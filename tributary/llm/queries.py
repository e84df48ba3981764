"""The operators' queries over the whole given tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import (
    byte_bpe,
    chat,
    cross_tokenizer,
    embedding_dedup,
    fingerprints,
    licenses,
    mixing,
    periods,
    pii,
    sharding,
    simhash,
    token_files,
    toxicity,
)
from tributary.llm.common import WORD, hex64, table


#: What both turns of conversation -7 say.
CONFLICT = r"\### Assistant: </turn> ok"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.severities(docs, model)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decode=True)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(table(spark, sf_dir, "documents"), shards=16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.grouped(table(spark, sf_dir, "documents"), width=3, bits=2, seed=42)
    return rows.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = token_files.write(docs, token_files.shared_path(docs), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.contents(spark, path)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id", *map(count, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def labels(found):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    scans = licenses.scans(table(spark, sf_dir, "documents")).withColumn("base", F.filter("found", lambda x: x["base"]))
    places = F.transform("base", lambda x: x["place"])
    return scans.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the decimal id is divisible by ten, the words from a place on repeat with a period, both by that number."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    chosen = chosen.withColumn("words", words).withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    a, p = F.col("a"), F.col("p")
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i))
    planted = F.array_join(F.transform(places, lambda i: F.get("words", i.cast("int"))), " ")
    return chosen.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.runs(with_planted_period(table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    found = found.withColumn("first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("first")["col2"]).alias("start"), F.col("first")["length"].alias("length"), (-F.col("first")["col3"]).alias("period"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
    return found.withColumn("exponent_milli", F.expr("1000 * length div period"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return cross_tokenizer.counted(table(spark, sf_dir, "documents"), *paths)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = [(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)]
    return chat.read_back(chat.formatted(given.union(spark.createDataFrame(own, given.schema))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_byte_bpe, op3_sharding, op4_simhash, op5_token_files, op6_embedding_dedup, op7_pii,
        op8_mixing, op9_licenses, op10_fingerprints, op11_periods, op12_alignment, op13_chat, pipeline,
    )
}

ORACLE = {
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), fit AS (
            SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS len FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.93
        ), reach AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
        SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(low, v.vec_id)) AS component_id,
               v.vec_id <= coalesce(low, v.vec_id) AS kept
        FROM v LEFT JOIN counts ON counts.a = v.vec_id LEFT JOIN lowest ON lowest.a = v.vec_id
    """,
    "op13_chat": rf"""
        WITH given AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'
        ), made AS (
            SELECT *, CASE WHEN role IS NULL THEN '-' WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role
                      ELSE '=' || url_encode(role) END AS name,
                   len(regexp_extract_all(text, '\\*(?:</turn>|### [A-Za-z0-9_.~%=-]+: )')) AS conflicts FROM given
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(15 + length(name) + length(text) + conflicts)::BIGINT AS formatted_chars
        FROM made GROUP BY conv_id
    """,
}
