"""Each operator against a plain computation on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tributary.llm import (
    byte_bpe, embedding_dedup, fingerprints, licenses, mixing, pii, sharding, simhash, simhash_similar, token_files, toxicity,
)
from tributary.llm.components import components

LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(6000))
TEXTS = [
    "Released under the MIT license. Mail bob.x@mail.example.com or +1 (555) 123-4567 today",
    "", None, " \n\t ", "one", "One two", LONG, LONG + " end", "a" * 3000, "The card 4111 1111 1111 1111 and 10.0.0.255, not 10.0.0.256.",
    "IBAN DE89 3704 0044 0532 0130 00 of the bank", "IBAN DE89 3704 0044 0532 0130 01 of the bank", "café ½ Ⅷ 中文 😀 it's WE'RE  two\u00a0blanks",
    "password=abcdef0123456789 and token: zz", "licensed under CC BY-NC 4.0, under the terms of the GNU Lesser General Public License",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, size string, label string, part string, shard string, n_tokens string"


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", ["b", "a", None][i % 3]) for i, t in enumerate(TEXTS)]
    out += [(100, "one", "en", "a"), (100, "one", "en", "a"), (None, "one two", "en", "a"), (None, None, None, None)]
    return [(i, t, g, s, None if t is None else len(t), *["x"] * 7) for i, t, g, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def key(row):
    return row[0] is None, row[0] or 0


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decode=True).collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in got) == sorted((library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows)
    back = byte_bpe.decode(byte_bpe.encode(docs, path, r"\S+|\s+"), path).collect()  # another pattern
    assert sorted(bytes(r.decoded) for r in back) == sorted((r[1] or "").encode() for r in rows)
    assert byte_bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_merges_a_vocabulary_whose_merges_make_smaller_ranks():
    tokens = [bytes([b]) for b in range(256)] + [b"cab", b"ab", b"abc", b"bca", b"abab"]
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    vocabulary = byte_bpe.Vocabulary(lines)

    def one_by_one(part):
        ids = list(part)
        while True:
            found = [(vocabulary.ranks.get(tokens[a] + tokens[b], 10**9), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
            if not found or min(found)[0] == 10**9:
                return ids
            rank, i = min(found)
            ids[i : i + 2] = [rank]

    for part in (b"abcabcab" * 60, b"ababab" * 90, b"cababcab" * 40, b"xaby" * 80):
        assert vocabulary.encode([part])[0].tolist() == one_by_one(part)


def test_sharding(docs, rows, empty):
    got = sharding.sharded(docs, shards=4, slots=64).collect()
    assert sorted(r["size"] for r in got) == sorted(len((r[1] or "").encode()) + 1 for r in rows)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    for shard in range(4):
        places = sorted(r.place for r in got if r.shard == shard)
        assert places == list(range(len(places)))
    assert sharding.sharded(empty, shards=4).count() == 0


def test_shard_maps():
    sizes = {s: (s * 7919) % 1000 + 1 for s in range(512)}
    start = sharding.first_map(512, 16)
    even = sharding.rebalanced(start, sizes, 16)
    load = sharding.loads(even, sizes, 16)
    assert max(load) - min(load) <= 0.01 * sum(load) / 16 and sum(a != b for a, b in zip(start.values(), even.values())) < 256
    more = sharding.grown(even, sizes, 16)
    moved = {s for s in even if even[s] != more[s]}
    assert moved and all(more[s] == 16 for s in moved)
    assert abs(sharding.loads(more, sizes, 17)[16] - sum(sizes.values()) / 17) <= 1000


def test_the_map_is_stored_by_version_and_edited(spark, docs, rows, tmp_path):
    """Another session's reader sees the versions; growing moves rows into the new shard only; no version is written twice."""
    folder = str(tmp_path / "map")
    many = [(i, f"text {i * 7919 % 997} " * (1 + i % 40), None) for i in range(3000)]
    table = spark.createDataFrame([m[:2] for m in many], "doc_id long, text string")
    first = {r.doc_id: (r.shard, r.virtual_slot) for r in sharding.sharded(table, shards=8, slots=512, folder=folder).collect()}
    load = [sum(len(t) + 1 for i, t, _ in many if first[i][0] == shard) for shard in range(8)]
    assert max(load) - min(load) <= 0.01 * sum(load) / 8
    made = spark.read.parquet(folder)
    assert sorted(r.version for r in made.select("version").distinct().collect()) == [0, 1]
    slots = {r.slot: r.shard for r in made.where("version = 1").collect()}
    assert len(slots) == 512 and all(slots[slot] == shard for shard, slot in first.values())

    sized = sharding.sized(table, 512)
    assert sharding.grow(sized, folder) == 2
    grown = {r.doc_id: r.shard for r in sharding.shards_of(sized, sharding.stored_map(spark, folder), 2).collect()}
    moved = {i for i in grown if grown[i] != first[i][0]}
    assert moved and all(grown[i] == 8 for i in moved)
    even = sum(load) / 9
    assert abs(sum(len(t) + 1 for i, t, _ in many if grown[i] == 8) - even) < 0.1 * even
    # A later run goes on from the newest version.
    assert {r.shard for r in sharding.sharded(table, slots=512, folder=folder).collect()} == set(range(9))
    assert sharding.latest(spark, folder)[0] == 3
    with pytest.raises(Exception, match="(?i)already exists"):
        sharding.store_version(spark, folder, 1, slots, {})


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    got = simhash.grouped(docs).collect()
    want = sorted((key((r[0],)), plain_fingerprint(r[1])) for r in rows)
    assert sorted((key((r.doc_id,)), r.fp % 2**64) for r in got) == want
    assert len({r.root for r in got if r.doc_id in (1, 2, 3)}) == 1 and {r.component_id for r in got if r.doc_id == 3} == {1}
    assert simhash.grouped(empty).count() == 0


@pytest.mark.parametrize("small", [64, 1])
def test_simhash_links_are_those_of_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)  # 1: every posting goes the way of large ones
    random = np.random.default_rng(3)
    fps = [int(x) for x in random.integers(-(2**63), 2**63 - 1, 40)]
    for base in fps[:20]:
        for _ in range(6):
            bits = random.choice(64, random.integers(1, 5), replace=False)
            changed = (base % 2**64) ^ sum(1 << int(b) for b in bits)
            fps.append(changed - 2**64 if changed >= 2**63 else changed)
    fps = sorted(set(fps))
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    near = {a: [b for b in fps if ((a ^ b) % 2**64).bit_count() <= 2] for a in fps}
    root, before = {x: x for x in fps}, None
    while root != before:
        before, root = root, {x: min(root[y] for y in near[x]) for x in fps}
    assert {x: got.get(x, x) for x in fps} == root


def test_similar_documents(spark, docs, rows, empty):
    words = [f"v{i}" for i in range(300)]
    near = [w if i % 60 else "changed" for i, w in enumerate(words)]
    other = [f"z{i}" for i in range(300)]
    made = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(words)), (4, " ".join(words)), (5, None)]
    table = spark.createDataFrame(made, "doc_id long, text string").withColumn("root", F.lit("clash"))
    kept = simhash_similar.one_per_group(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    assert simhash_similar.one_per_group(docs).columns == docs.columns
    assert simhash_similar.one_per_group(empty).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_of(spark, made):
    return sorted(r.doc_id for r in simhash_similar.one_per_group(spark.createDataFrame(made, "doc_id long, text string")).collect())


def test_similar_pairs_are_all_found(spark):
    made = []
    for k in range(150):  # 8 of 10 shingles: a similarity of exactly 0.8, and no third text to be found by
        words = [f"p{k}x{i}" for i in range(14)]
        made += [(k, " ".join(words)), (1000 + k, " ".join(words[:12]))]
    assert kept_of(spark, made) == list(range(150))


@pytest.mark.parametrize("sample, tile", [(16, 1024), (1, 16)])
def test_similar_links_are_exact(spark, monkeypatch, sample, tile):
    monkeypatch.setattr(simhash_similar, "SAMPLE", sample)
    monkeypatch.setattr(simhash_similar, "TILE", tile)
    draw = np.random.default_rng(3)
    line, made = [f"common{i}" for i in range(20)], []
    for k in range(12):
        base = [f"b{k}x{i}" for i in range(30 if k else 80)]
        for n in range(50 if k == 0 else 4):  # one large group, edited more and more, and small ones; all hold the line
            words = [w if draw.random() > 0.002 * n else f"e{k}x{n}x{i}" for i, w in enumerate(line + base)]
            made.append((len(made), " ".join(words[: len(words) - n % 6])))
    sets = {i: shingles(t) for i, t in made}
    root, before = {i: i for i in sets}, None
    near = {i: [j for j in sets if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in sets}
    while root != before:
        before, root = root, {i: min(root[j] for j in near[i]) for i in sets}
    assert 20 < len(set(root.values())) < len(made) - 20
    assert kept_of(spark, made) == sorted(set(root.values()))


def test_similar_ignores_repeats(spark):
    line = " ".join(f"line{i}" for i in range(16))
    one, other = (" ".join(f"{x}{i}" for i in range(200)) for x in "ab")
    made = [(1, f"{line} " * 20 + one), (2, f"{line} " * 20 + other), (3, f"{line} {line} " + one + " end"), (4, one + " end")]
    sets = [shingles(t) for _, t in made]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.1 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) > 0.9
    assert kept_of(spark, made) == [1, 2]


def test_token_files(docs, rows, empty, spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(name)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -1 if r[1] is None else zlib.crc32(r[1].encode())))
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ordered]
    want, start = [], 0
    for row, x in zip(ordered, ids):
        want.append((row[0], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    for plane in ("bit", "byte"):
        path = token_files.write(docs, str(tmp_path / plane), name, plane=plane)
        got = token_files.contents(spark, path, plane)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
        read = token_files.read(spark, path, plane).collect()
        assert [i for r in sorted(read, key=lambda r: (r.part, r.doc, r.block)) for i in r.ids] == [i for x in ids for i in x]
    assert token_files.contents(spark, token_files.write(empty, str(tmp_path / "none"), name)).count() == 0


def test_documents_over_blocks():
    ids = np.random.default_rng(1).integers(0, 49_408, 3 * token_files.BLOCK + 5).astype(np.uint32)
    docs = [(1, ids[:10]), (2, ids[10:-3]), (None, ids[:0]), (3, ids[-3:])]
    blocks = [b.to_pylist()[0] for b in token_files.blocks(iter(docs), 0, "bit")]
    assert [b["n"] for b in blocks] == [token_files.BLOCK] * 3 + [5]
    assert (np.concatenate([token_files.from_planes(b["planes"], b["n"]) for b in blocks]) == ids).all()
    cuts = [ids[:70_000], ids[70_000:70_001], ids[70_001:]]
    assert token_files.joined_crc([token_files.checksum(c) for c in cuts], [4 * len(c) for c in cuts]) == token_files.checksum(ids)
    words = token_files.Words(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    before = words.ids(["some words here, some there."])
    assert words.ids(["some words here, some there."]) == before


@pytest.mark.parametrize("tile", [4096, 7])
def test_embeddings(spark, tile):
    random = np.random.default_rng(5)
    base = random.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + random.normal(size=16) * 0.02 * (i % 9)).tolist(), i % 2 if i % 12 else 1) for i in range(90)]
    rows += [(90, rows[3][1], rows[3][2]), (91, rows[3][1], rows[3][2]), (92, None, 1), (93, [0.0] * 16, 1), (94, [float("nan")] * 16, 1)]
    rows += [(95, [None] * 16, 1), (96, rows[3][1], None), (97, [1.0], 1), (98, [-0.0] * 15 + [2.0], 1), (99, [0.0] * 15 + [5.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_copies(table, tile=tile).collect()}

    def near(a, b):
        (i, x, p), (j, y, q) = a, b
        fine = all(v is not None and None not in v and np.isfinite(v).all() and any(v) for v in (x, y)) and len(x) == len(y)
        return i != j and p == q and p is not None and fine and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.93

    links = {a[0]: [b[0] for b in rows if near(a, b)] for a in rows}
    root = {i: i for i in links}
    for _ in links:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
    assert got == {i: (len(links[i]), root[i], root[i] == i) for i in links}
    assert sum(map(len, links.values())) > 100


def test_the_largest_and_smallest_doubles_link(spark):
    base = np.random.default_rng(8).normal(size=8)
    base /= np.abs(base).max()
    scales = [1e200, -1e200, 1e-200, 1.7e308, 1e-306, 1.0]
    rows = [(i, (base * s).tolist(), 1) for i, s in enumerate(scales)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_copies(table).collect()}
    assert got == {i: (0, 1) if i == 1 else (4, 0) for i in range(6)}
    assert embedding_dedup.near_copies(table.limit(0)).count() == 0


def test_quantised_bounds_hold():
    random = np.random.default_rng(2)
    rows = random.normal(size=(200, 24)) * random.lognormal(size=(200, 1))
    unit, whole, scale, error = embedding_dedup.quantised(rows)
    product = (whole.astype(float) @ whole.T) * scale[:, None] * scale
    length = np.sqrt((whole.astype(float) ** 2).sum(1)) * scale
    assert (np.abs(unit @ unit.T - product) <= error[:, None] + length[:, None] * error + embedding_dedup.ROUNDING).all()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
            fits = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((m.start(), number, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_personal_data(docs, rows, empty):
    got = pii.personal_data(docs).collect()
    base = sorted((key((r.doc_id,)), [(s.kind, s.start, s.end) for s in r.found if s.kind in pii.BASE]) for r in got)
    assert base == sorted((key((r[0],)), plain_spans(r[1])) for r in rows)
    kinds = {r.doc_id: [s.kind for s in r.found] for r in got}
    assert kinds[10] == ["iban"] and kinds[11] == [] and kinds[13] == ["secret"] and kinds[9] == ["card", "ip"]
    assert pii.personal_data(empty).count() == 0
    clean = {r[0]: r[1] for r in docs.select("doc_id", pii.redacted(F.col("text"))).collect()}
    assert clean[0] == "Released under the MIT license. Mail [EMAIL] or [PHONE] today" and clean[4] == "one" and clean[2] is None


def test_base_spans_of_random_texts():
    random = np.random.default_rng(7)
    parts = ["a@b.c", "@", "x.y@z", "1.2.3.4", "4111111111111111", "+4", "5 ", "-", ".", "(", "9", "a", " ", "é", "4-1", "0"]
    for _ in range(3000):
        text = "".join(random.choice(parts, random.integers(0, 14)))
        assert [(s["kind"], s["start"], s["end"]) for s in pii.find(text) if s["kind"] in pii.BASE] == plain_spans(text), text


def test_context_moves_the_score():
    with_word, without = (pii.find(t)[0]["score"] for t in ("call +1 555 123 4567", "see +1 555 123 4567"))
    assert with_word > without
    assert pii.find("ssn 123-45-6789")[0]["kind"] == "ssn" and pii.find("order 123-45-6789") == []


def test_mixture(spark, docs, rows, empty):
    got = mixing.mixture(docs).collect()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    assert sorted(r["size"] for r in got) == sorted(sizes)
    total = {s: sum(n for n, r in zip(sizes, rows) if r[3] == s) for s in ("a", "b", None)}
    assert {r.source: r.source_size for r in got} == total
    target, weight = {}, {"a": 5, "b": 2, None: 1}
    full = set()
    while True:  # fill by weight, cap, share the rest again
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        level = left / max(1, sum(w for s, w in weight.items() if s not in full))
        target = {s: 2 * total[s] if s in full else level * w for s, w in weight.items()}
        over = {s for s in target if target[s] > 2 * total[s] + 1e-9}
        if not over:
            break
        full |= over
    assert {r.source: pytest.approx(r.target) for r in got} == target
    assert all(0 <= r.copies <= 2 for r in got)
    assert mixing.mixture(empty).count() == 0 and mixing.repeated(empty).columns == empty.columns


def test_taken_words_come_near_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)  # many buckets: the reduction tree has levels
    monkeypatch.setattr(mixing, "FAN", 4)
    random = np.random.default_rng(9)
    made = [(i, " ".join(["w"] * int(n)), f"s{i % 5}" if i % 3 else "hot") for i, n in enumerate(random.lognormal(3, 1, 1500))]
    table = spark.createDataFrame(made, "doc_id long, text string, source string")
    first, second = (sorted(map(tuple, mixing.mixture(table).collect())) for _ in range(2))
    assert first == second
    for source in {r[1] for r in first}:
        mine = [r for r in first if r[1] == source]
        assert abs(sum(r[3] * r[6] for r in mine) - mine[0][5]) <= 0.02 * mine[0][5]
    taken = mixing.repeated(table)
    assert taken.columns == table.columns
    words = {r[0]: r[1] for r in taken.groupBy("source").agg(F.sum(F.size(F.split("text", " ")))).collect()}
    for source, target in {(r[1], r[5]) for r in first}:
        assert abs(words[source] - target) <= 0.02 * target


def test_licenses(docs, rows, empty):
    got = {(key((r.doc_id,)), r.n_words): r for r in licenses.scans(docs).collect()}
    for row in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), row[1] or ""))
        found = got[key((row[0],)), len(words)].found
        want = [
            (i, label) for i in range(len(words)) for phrase, label in licenses.BASE if words[i : i + len(phrase.split())] == phrase.split()
        ]
        assert [(s.place, s.label) for s in found if s.base] == want
    assert {s.label for r in got.values() if r.doc_id == 14 for s in r.found} == {"cc-by-nc", "lgpl"}
    assert licenses.scans(empty).count() == 0


def test_fingerprints(docs, rows, empty):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -1 if r[1] is None else zlib.crc32(r[1].encode())))
    texts = [r[1] or "" for r in ordered]
    got = fingerprints.against_next(docs).collect()
    want = []
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        changed = fingerprints.edited(text, after)
        a, b, c = (fingerprints.sketches([t])[0] for t in (text, changed, after))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        want.append((key((ordered[i][0],)), len(text), sha, fingerprints.written(a), fingerprints.written(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted((key((r[0],)), *r[1:]) for r in got) == sorted(want)
    assert fingerprints.against_next(empty).count() == 0
    one = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert one[1] == "" and one[4] == one[100]


def test_equal_substrings_have_equal_interior_names():
    random = np.random.default_rng(8)
    text, unlike = ("".join(random.choice(list("abcdefgh ij"), 8000)) for _ in range(2))
    a, b = (set(fingerprints.sketches([t])[0]) for t in (text, "some other beginning " + text))
    assert len(a & b) >= 0.9 * len(a)
    assert fingerprints.likeness(fingerprints.sketches([text])[0], fingerprints.sketches([unlike])[0]) < 0.2


def test_toxicity(spark, docs, empty):
    random = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(400)]
    made, marks = [], []
    for i in range(600):
        words = random.choice(plain, 40).tolist()
        if i % 5 == 0:
            words += random.choice(["badword", "awful", "nastyish"], 1 + i % 3).tolist()
        made.append((i, " ".join(words)))
        marks.append((i, int(i % 5 == 0) if i % 7 else None))
    table = spark.createDataFrame(made, "doc_id long, text string").withColumn("severity", F.lit("clash"))
    labels = spark.createDataFrame([*marks, (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = toxicity.severities(table, model).collect()
    assert sum(r.rejected == (r.doc_id % 5 == 0) for r in got) >= 594
    assert list(model.thresholds) == sorted(model.thresholds) and model.held_out["f1"] > 0.95
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got)
    assert [r.rejected for r in toxicity.severities(docs, model).where("doc_id in (1, 2, 3)").collect()] == [False] * 3
    kept = table.where(toxicity.accepted(F.col("text"), model, spark))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.rejected}
    none = toxicity.fit(empty, labels)
    assert not any(r.rejected for r in toxicity.severities(docs, none).collect())


def test_ordinal_gradient():
    random = np.random.default_rng(6)
    x = [np.flatnonzero(random.random(5) < 0.5) for _ in range(300)]
    total = np.array([1.5 * (0 in a) + 2.5 * (1 in a) for a in x]) + random.logistic(size=300) * 0.3
    y = (total > 1.2).astype(int) + (total > 3)
    weights, cuts = toxicity.fit_thresholds(x, y, 5)
    assert weights[1] > weights[0] > 1 and np.abs(weights[2:]).max() < 1 and cuts[0] < cuts[1]


def test_components_of_a_chain_a_hub_and_repeats(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(200)] + [(5, 4), (5, 4), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(200)}}


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize("either", ["either ", ""])
def test_gpl_notice(spark, version, either):
    notice = f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, {either}version {version} of the License, or (at your option) any later version."""
    lesser = notice.replace("General", "Lesser General")
    made = spark.createDataFrame([(1, notice), (2, lesser)], "doc_id long, text string")
    got = {r.doc_id: {f.label for f in r.found} for r in licenses.scans(made).collect()}
    assert got == {1: {f"gpl-{version}"}, 2: {"lgpl"}}


def test_iban_before_capital_words():
    for iban in ("BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00"):
        for after in ("", " EUR", " BIC ABCD EUR", ", EUR", " BE68 5390 0754 7034 EUR"):
            found = [s for s in pii.find(f"account {iban}{after}") if s["kind"] == "iban"]
            assert [f"account {iban}{after}"[s["start"] : s["end"]] for s in found] == [iban, "BE68 5390 0754 7034"][: 2 if "BE" in after else 1]
    assert [s["start"] for s in pii.find("account NO12 BE68 5390 0754 7034") if s["kind"] == "iban"] == [13]
    assert pii.redact("pay BE68 5390 0754 7034 EUR") == "pay [IBAN] EUR"


def test_rows_of_one_id_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    rows = spark.createDataFrame([("x" if i % 3 else f"y{i}", "a", 0, 8) for i in range(3000)], "doc_id string, source string, tie long, size long")
    sizes = [r["count"] for r in mixing.bucketed(rows, False, 8).groupBy("source", "class", "bucket").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 150
    same = spark.createDataFrame([(None, "one two three", "a")] * 500 + [(1, "four", "b")], "doc_id long, text string, source string")
    taken = mixing.repeated(same)
    words = {r.source: r.n for r in taken.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert abs(words["a"] - 1500 * 1.5) <= 6
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(.*_nth#\d+( as bigint\))? = _mark_nth#", plan)


def test_null_and_empty_ids_are_two(spark):
    ids = [None, "", "\0", "\0x", "plain"]
    table = spark.createDataFrame([(x, "one two three four", "s") for x in ids], "doc_id string, text string, source string")
    assert sorted(repr(r.doc_id) for r in mixing.mixture(table).collect()) == sorted(map(repr, ids))


def test_all_names_of_long_texts(spark, docs, empty):
    passage = " ".join(f"shared{i * 31 % 97}" for i in range(60))
    one, other = (" ".join(f"{x}{i * 7919 % 10007}" for i in range(10000)) for x in "ab")
    texts = {1: f"{one} {passage} end", 2: f"{passage} {other}", 3: other}
    assert not {*fingerprints.sketches([texts[1]])[0]} & {*fingerprints.sketches([texts[2]])[0]}
    rows = fingerprints.names_of(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found = {i: {(r.level, r.name): r.place for r in rows if r.doc_id == i} for i in texts}
    first, second = texts[1].index(passage), texts[2].index(passage)
    both = [(found[1][k] - first, found[2][k] - second) for k in found[1].keys() & found[2].keys()]
    inside = [a for a, b in both if a == b and 0 <= a < len(passage)]
    assert len(inside) > 20
    for i in texts:  # the fingerprint is made of these names
        every = {int(fingerprints.mixed(np.array([n], np.int64).view(np.uint64) + np.uint64(v))[0] >> np.uint64(32)) for v, n in found[i]}
        assert tuple(sorted(every)[: fingerprints.KEPT]) == fingerprints.sketches([texts[i]])[0]
    assert fingerprints.names_of(empty).count() == 0 and fingerprints.names_of(docs).where("place < 0 or name is null").count() == 0
