"""Ids of words against the tokenizers library on whole texts, special tokens in every letter case among them."""

import random

import numpy as np
import public_tokenizers
import pytest

from tributary.llm import token_files

BITS = [
    "a", "The", " ", "  ", "\n", "\t", "é", "É", "ß", "ẞ", "÷", "ſ", "K", "İ", "中", "'s", "'", "1", "½", "😀", "!", "...", ".,", "<|endoftext|>", "<|ENDOFTEXT|>",
    "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "endoftext", "́", " ", "​", "ﬁ", "Å", "\r", "Ⅷ", "\x1c", "_", "%%%", "ª", "µ", "don't", "ÿ",
]


@pytest.mark.parametrize("cache", [token_files.CACHE, 50])
def test_ids_equal_the_library(monkeypatch, cache):
    monkeypatch.setattr(token_files, "CACHE", cache)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = token_files.Words(f.read())
    assert words.by_piece
    rng = random.Random(cache)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(14))) for _ in range(6000)] + ["", "<|ENDOFTEXT|>", "x<|endoftext|>y"]
    got = [np.frombuffer(ids, "<u4").tolist() for i in range(0, len(texts), 300) for ids in words.ids(texts[i : i + 300])]
    assert got == [e.ids for e in words.encode(texts, add_special_tokens=False)]
    assert len(words.known) <= cache
