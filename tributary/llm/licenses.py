"""License scans by a positional index of rare template words.

The templates are short standard passages of well-known licenses. Their words form a small index: word -> (template, place).
A first pass counts in how many documents each of these words stands (all documents, one row per task and word). The
second looks up, in each document, the words of highest inverse document frequency of each template: every occurrence at
document word w of a template word at place p votes for the template beginning at w - p. Beginnings with enough
of the template's rare weight are candidates, and a candidate counts only if the template's mandatory key phrase
stands at its own place there, word by word.

The base phrases are templates whose rare words are looked up in the same way and whose whole text is the key phrase: a place is
a base place exactly when all words of the phrase stand there. Labels of other templates are added to theirs.
The score is the largest share of a template's rare weight found at a verified place; 0 without any.

Words are lower-cased (A to Z) runs of ASCII letters, digits and characters beyond ASCII. Null texts count as empty: no words, no
places, null first and last word, empty labels. Repeated rows give repeated rows. Nothing but word counts is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import documents_of, pieces, texts_of

#: Phrase and label of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Standard passages of licenses: label, passage, mandatory key phrase within it (fixed values, the licenses' own words).
PASSAGES = (
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    # The standard notices have other words between the license's name and its version.
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", "gnu general public license as published by the free software foundation version 3 of the license", "gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", "gnu general public license as published by the free software foundation version 2 of the license", "gnu general public license as published by the free software foundation version 2 of the license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license version 3", "gnu affero general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "you may not use this file except in compliance with the license", "use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "use copy modify and or distribute this software"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
)
#: Rare words looked up per template, and the share of their weight that makes a candidate.
RARE, ENOUGH = 3, 0.6
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _KEEP else 32 for b in range(256))


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    key: int  # where the key phrase begins
    key_words: tuple[bytes, ...]
    base: bool


def _templates() -> list[Template]:
    out = []
    for passage, label in BASE:
        words = tuple(passage.encode().split())
        out.append(Template(label, words, 0, words, True))
    for label, passage, phrase in PASSAGES:
        words, key = tuple(passage.encode().split()), tuple(phrase.encode().split())
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append(Template(label, words, at, key, False))
    return out


TEMPLATES = _templates()
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def frequencies(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the templates stands; under the empty word, the number of documents."""
    every = frozenset(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in pieces(batches):
            for t in texts_of(batch):
                count[b""] += 1
                count.update(every.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r[0]): r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()}  # as many rows as template words


class Index:
    """Rare words of each template by inverse document frequency, and where they stand."""

    def __init__(self, count: dict[bytes, int]):
        total = count.get(b"", 0)
        idf = {w: math.log((1 + total) / (1 + count.get(w, 0))) + 1e-3 for w in VOCABULARY}
        self.postings: dict[bytes, list[tuple[int, int, float]]] = {}
        self.full = []
        for number, t in enumerate(TEMPLATES):
            first = {w: i for i, w in reversed(list(enumerate(t.words)))}
            rare = sorted(first, key=lambda w: (-idf[w], w))[:RARE]
            self.full.append(sum(idf[w] for w in rare))
            for w in rare:
                self.postings.setdefault(w, []).append((number, first[w], idf[w]))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(place, template, share of the rare weight) of verified places."""
        postings = self.postings
        votes: dict[tuple[int, int], float] = {}
        if not postings.keys().isdisjoint(words):
            for at, word in enumerate(words):
                if word in postings:
                    for number, place, weight in postings[word]:
                        votes[at - place, number] = votes.get((at - place, number), 0.0) + weight
        out = []
        for (begin, number), weight in votes.items():
            t, share = TEMPLATES[number], weight / self.full[number]
            key = begin + t.key
            if share >= (1 - 1e-9 if t.base else ENOUGH) and key >= 0 and tuple(words[key : key + len(t.key_words)]) == t.key_words:
                out.append((begin, number, min(1.0, share)))
        return sorted(out)


def scans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, found array<struct<place, label, base, share>> by place."""
    source = documents_of(docs, doc_id, text)
    count = frequencies(source)
    spans = pa.list_(pa.struct([("place", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(count)
        for batch in pieces(batches):
            sizes, found = [], []
            for t in texts_of(batch):
                words = words_of(t)
                sizes.append(len(words))
                found.append([{"place": p, "label": TEMPLATES[n].label, "base": TEMPLATES[n].base, "share": s} for p, n, s in index.scan(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, spans)], ["doc_id", "n_words", "found"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, found array<struct<place: long, label: string, base: boolean, share: double>>")
