"""Alignment against a plain comparison of byte ranges, with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tributary.llm import cross_tokenizer
from tributary.llm.queries import QUERIES

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = "doc_id long, text string, lang string, chunk string, codes string, held string, n_a string"


def spelled(token):
    """Bytes of a byte-level token, by encoding every character of the vocabulary's alphabet back."""
    table, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[chr(b)] = b
        else:
            table[chr(free)] = b
            free += 1
    return bytes(table[c] for c in token)


def piece_bytes(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def ranges(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


@pytest.fixture(scope="module")
def plain():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)

    def run(rows):
        made, counts = [], Counter()
        for name, text in rows:
            a = b = links = groups = []
            if text:
                a, b = library.encode(f" {text}", add_special_tokens=False).ids, pieces.encode(text)
                sa, sb = [spelled(library.id_to_token(i)) for i in a], [piece_bytes(pieces.id_to_piece(i)) for i in b]
                if b"".join(sa) != f" {text}".encode() or b"".join(sb) != f" {text}".encode():
                    a = b = []
                ra, rb = ranges(sa) if a else [], ranges(sb) if a else []
                links = [(i, j) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
                common = sorted({x[1] for x in ra} & {y[1] for y in rb})
                groups = [([i for i, x in zip(a, ra) if s < x[1] <= e], [i for i, y in zip(b, rb) if s < y[1] <= e]) for s, e in zip([0, *common], common)]
                counts.update({(a[i], b[j]) for i, j in links})
            made.append((name, a, b, links, groups))
        most = Counter()
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        out = []
        for name, a, b, links, groups in made:
            pairs = [(a[i], b[j]) for i, j in links]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
            out.append((name, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), digest))
        return out, made

    return run


SHOWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*SHOWN).collect()), key=str)


TEXTS = [
    None, "", " ", "one", "One two  three\n\nfour\t5", " leading", "café ½ Ⅷ 中文 😀🧑‍🚀 ͸ it's WE'RE", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ under ▁▁",
    " ​﻿ x\r\n", "a" * 500, "the the the", "the the the", "\x00 nul", "é" * 40 + " " * 30, "ﬁ ﬂ Å Å",
]


def test_operator(spark, plain, monkeypatch):
    rng = random.Random(3)
    random_texts = ["".join(rng.choices(["a", "The", " ", "  ", "\n", "é", "中", "'s", "1", "😀", "!", "▁", "<0x0A>", "́"], k=rng.randrange(40))) for _ in range(150)]
    rows = [(i, t, *"abcde") for i, t in enumerate(TEXTS + random_texts)] + [(None, "the end", *"abcde"), (7, "again", *"abcde"), (7, "again", *"abcde")]
    rows += [(None, None, *[None] * 5)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    want, made = plain([r[:2] for r in rows])
    assert rows_of(cross_tokenizer.counted(df, A, B)) == sorted(want, key=str)
    whole = cross_tokenizer.aligned(df, A, B).collect()
    got = [(r.doc_id, r.a_ids, r.b_ids, [(x.a, x.b) for x in r.links], len(r.groups)) for r in whole]
    assert sorted(got, key=str) == sorted([(n, a, b, links, len(g)) for n, a, b, links, g in made], key=str)


def test_counts_over_many_chunks(spark, plain):
    rows = [(i, "the cat sat on the mat" if i % 3 else f"the word number {i}") for i in range(400)]
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], COLUMNS).repartition(7)
    assert rows_of(cross_tokenizer.counted(df, A, B)) == sorted(plain(rows)[0], key=str)


def test_long_text(spark, plain):
    row = (1, " ".join(f"wörd{i * 7919 % 1013}" for i in range(30_000)), *"abcde")
    (got,) = cross_tokenizer.counted(spark.createDataFrame([row], COLUMNS), A, B).collect()
    assert got.n_links == got.n_a + got.n_b - got.n_groups and got.n_a > 30_000


def test_no_rows(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert cross_tokenizer.counted(empty, A, B).collect() == [] and cross_tokenizer.aligned(empty, A, B).collect() == []


def test_query(spark, sf, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6000]
    small = spark.createDataFrame([(*r, *"abcde") for r in docs], COLUMNS)
    assert rows_of(cross_tokenizer.counted(small, A, B)) == sorted(plain(docs)[0], key=str)
    assert QUERIES["op12_alignment"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
