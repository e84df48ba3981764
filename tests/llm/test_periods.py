"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tributary.llm import periods
from tributary.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, runs string, collapsed string, n_words string"


def plain_runs(words, min_length=6, min_exponent=4):
    out = {}
    for p in range(1, len(words) // min_exponent + 1):
        start = None
        for k in range(len(words) - p + 1):
            if k < len(words) - p and words[k] == words[k + p]:
                start = k if start is None else start
            elif start is not None:
                if k + p - start >= max(min_length, min_exponent * p):
                    out.setdefault((start, k + p), p)
                start = None
    return sorted((a, b - a, p) for (a, b), p in out.items())


def plain_collapsed(words, runs):
    drop = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


@pytest.mark.parametrize("seed", range(4))
def test_runs_after_every_append(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randrange(70))]
        if words:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 2))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        least, exponent = rng.choice([(6, 4), (2, 2), (3, 2), (6, 3)])
        catchers, at = periods.Catchers(least, exponent), 0
        while at < len(words):
            step = rng.choice([1, 2, 9, 40])
            catchers.append(np.array(words[at : at + step], np.int64))
            at = min(len(words), at + step)
            assert catchers.runs() == plain_runs(words[:at], least, exponent)


def test_long_runs_and_many_multiples():
    for words in (np.zeros(50_000, np.int64), np.arange(50_000) % 4001, np.concatenate([np.arange(999), np.arange(50_000) % 7])):
        catchers = periods.Catchers()
        catchers.append(words.astype(np.int64))
        (run,) = catchers.runs()
        assert run == {1: (0, 50_000, 1), 4001: (0, 50_000, 4001), 7: (999, 50_000, 7)}[len(set(words[-9999:].tolist()))]


def test_operator(spark):
    again = "a b c " * 9
    texts = [None, "", " \t\n", "one", "x " * 6, "x " * 5, again, f"p {again} q {again}", "a b " * 8, "é é é é é é", "w " * 60_000, "ab ab ab a b"]
    texts += [again] * 3 + ["x x", "x x x x"]  # nothing reaches from one document into the next
    rows = [(i, t, *"abcd") for i, t in enumerate(texts)] + [(None, again, *"abcd"), (None, None, None, None, None, None)]
    got = periods.runs(spark.createDataFrame(rows, COLUMNS).repartition(2)).collect()
    want = []
    for row in rows:
        words = [w.decode() for w in (row[1] or "").encode().split()]
        found = [(0, 60_000, 1)] if len(words) == 60_000 else plain_runs(words)
        want.append((row[0], len(words), found, plain_collapsed(words, found)))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=str) == sorted(want, key=str)
    assert periods.runs(spark.createDataFrame([], COLUMNS)).collect() == []


def test_query(spark, sf):
    import re

    got = {r.doc_id: r for r in QUERIES["op11_periods"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    planted = 0
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        if n > 4000:
            continue  # the plain search takes the square of the words
        runs, r = plain_runs(words), got[row.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert planted > 5 and any(r.n_runs for r in got.values())
