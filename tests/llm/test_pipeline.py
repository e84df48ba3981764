"""The pipeline's stages on the small tables, and that the entry works without the subpackage."""

import subprocess
import sys

import corpus_pipeline
import pyarrow as pa
from tributary.llm import pii, simhash, simhash_similar
from tributary.llm.queries import QUERIES


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "personal_data":
            assert all(not [s for s in pii.find(r.text) if s["kind"] in pii.BASE] and len(r.text) == r.n_chars for r in docs.collect())
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] == counts[4]
    assert all(r.lossless for r in docs.select("lossless").distinct().collect())
    assert QUERIES["pipeline"](spark, sf).count() == counts[-1]


def test_copies_by_fingerprint_and_by_sets(spark, sf):
    """Two texts around one much repeated line link by fingerprint only, two that differ in three words by their sets only."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    line, base = words("line", 13) + " ", words("word", 200).split()
    changed = [w if i not in (40, 100, 160) else "other" for i, w in enumerate(base)]
    texts = {1: line * 50 + words("x", 20), 2: line * 50 + words("y", 20), 3: " ".join(base), 4: " ".join(changed), 5: words("z", 50), 6: None, 7: ""}
    prints = {k: simhash.fingerprint(t or "") for k, t in texts.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2 < ((prints[3] ^ prints[4]) & (1 << 64) - 1).bit_count()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    alone = {r.doc_id for r in simhash_similar.one_per_group(docs).collect()}
    assert alone == {1, 2, 3, 5, 6}
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()} == {1, 3, 5, 6}


def test_stages_bound_the_rows_and_bytes_of_a_batch(spark, sf):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "if(id < 1500, repeat('word ', 2000), 'a b c') AS text", "9 AS n_chars")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    before = {name: spark.conf.get(name) for name in corpus_pipeline.BATCH}
    try:
        out = corpus_pipeline.drop_personal_data(spark, docs, sf)
        found = [(r.rows, r.bytes) for r in out.mapInArrow(sizes, "rows long, bytes long").collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(n for n, _ in found) == 3000
    assert max(n for n, _ in found) <= 1000 and max(n for _, n in found) < 5_000_000


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['tributary.llm'] = None\ntry:\n import tributary.llm\nexcept ModuleNotFoundError as e:\n print(e.name)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=".").stdout.strip() == "tributary.llm"
