"""What the rounds of connected components leave on disk."""

import time
from pathlib import Path

from tributary.llm import components as C
from tributary.llm.common import let_go


def shuffles(spark):
    root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    return {p.name.split("_")[1] for p in root.parent.rglob("shuffle_*")}


def test_shuffles_of_rounds_are_let_go(spark, monkeypatch):
    held = []
    monkeypatch.setattr(C, "let_go", lambda df: (held.append(shuffles(spark) - before), let_go(df)))
    before = shuffles(spark)
    found = C.components(spark.range(0, 500).selectExpr("id AS a", "id + 1 AS b"))
    assert len(held) == 1 and held[0]
    for _ in range(50):
        if not held[0] & shuffles(spark):
            break
        let_go(found)  # what the last round's variables held
        time.sleep(0.2)
    assert not held[0] & shuffles(spark)
    assert found.where("root = 0").count() == found.count() == 501
