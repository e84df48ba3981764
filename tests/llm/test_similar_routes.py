"""The pipeline's near-dedup gives the same rows where its narrow sides are broadcast and where they are shuffled."""

import random

import pytest

from tributary.llm import simhash_similar


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows, number = [], 0
    for _ in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(4, 60))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((number, " ".join(words)))
            number += 1
            if rng.random() < 0.5:
                words = words + [f"w{rng.randrange(400)}"]
    rows += [(number, ""), (number + 1, None), (None, "one two"), (None, "one two"), (7, rows[7][1]), (7, rows[7][1]), (7, "of its own"), (7, "of its own")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, root string, _key string").repartition(4)


def similar(a, b):
    def shingles(text):
        words = (text or "").split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    a, b = shingles(a), shingles(b)
    return a == b or len(a & b) / max(1, len(a | b)) >= 0.8


def brute(rows):
    """The row kept of each group, by comparing all pairs."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similar(rows[i].text, rows[j].text):
                group = [group[i] if g == group[j] else g for g in group]
    kept = {}
    for g, r in zip(group, rows):
        best = kept.setdefault(g, r)
        if (r.doc_id is None, r.doc_id or 0) < (best.doc_id is None, best.doc_id or 0):
            kept[g] = r
    return sorted(str(r.doc_id) for r in kept.values())


def test_same_rows_by_either_route(docs, monkeypatch):
    rows = docs.collect()
    want = brute(rows)
    near = simhash_similar.one_per_group(docs).collect()
    assert sorted(str(r.doc_id) for r in near) == want and near[0].asDict().keys() == rows[0].asDict().keys()
    monkeypatch.setattr(simhash_similar, "KNOWN", 2)
    monkeypatch.setattr(simhash_similar, "few", lambda rows, bound: False)
    far = simhash_similar.one_per_group(docs).collect()
    assert sorted(map(str, far)) == sorted(map(str, near))


def test_no_rows(spark, docs):
    assert simhash_similar.one_per_group(docs.limit(0)).collect() == []
