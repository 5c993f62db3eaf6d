import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexweave.llm import simhash
from lexweave.llm.bytesets import blocks, xxh64
from lexweave.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(rows):
    prints = {i: brute_print(t) for i, t in rows}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def test_xxh64_matches_the_library():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in [*range(0, 100), 1000, 1023, 1024, 5000]]
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    got = xxh64(np.frombuffer(b"".join(parts), np.uint8), starts, ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, seed=42) for p in parts]


def test_fingerprints_of_odd_texts():
    rng = random.Random(2)
    vocab = ["The", "été", "a", "Zürich", "x" * 50, "日本", "b c"]
    texts = ["", None, " \n", "one", "One two", "a b c", " lead", "trail ", "é"] + ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", "\t\x0b"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [" ".join(rng.choice(vocab) for _ in range(70_000))]
    for limit in (1, 100, 1 << 20):
        got = [int(x) for _, d, o in blocks(pa.array(texts), limit) for x in simhash.fingerprint_block(d, o)]
        assert got == [brute_print(t) for t in texts]


def test_forest_joins_what_brute_force_joins():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)} | set(base))
    a, b = simhash.forest(np.array(values, np.uint64))
    label = {v: v for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert bin(x ^ y).count("1") <= 2
        assert find(x) != find(y)
        label[find(x)] = find(y)
    for x in values:
        for y in values:
            if bin(x ^ y).count("1") <= 2:
                assert find(x) == find(y)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (None, 4), (20, 10), (20, 11), (12, 11)] + [(100, k) for k in range(101, 150)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {(r.node, r.root) for r in connected_components(df, "a", "b").collect()}
    want = {(1, 1), (2, 1), (3, 1), (9, 7), (8, 7), (7, 7), (20, 10), (10, 10), (11, 10), (12, 10)} | {(k, 100) for k in range(100, 150)}
    assert got == want
    assert connected_components(df.where("a > 1000"), "a", "b").count() == 0


@pytest.mark.parametrize("tile", [2, 2048])
def test_links_lose_nothing(spark, tile):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    values = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(0, 20)} | {rng.getrandbits(64) for _ in range(50)} | {3, 0, 7}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(df, tile)
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    mask = (1 << 64) - 1
    label = {v: v for v in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(signed):
        for y in signed[:i]:
            if bin((x ^ y) & mask).count("1") <= 2 and find(x) != find(y):
                p, q = sorted((find(x), find(y)))
                label[q] = p
    assert {v: got.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], [[rng.choice(vocab) for _ in range(200)] for _ in range(6)]
    for i in range(80):
        words = list(rng.choice(base))
        if i % 3:
            words[rng.randrange(200)] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(90, None), (91, ""), (92, "\n"), (93, "solo"), (94, "Solo")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, n int")
    got = {tuple(r) for r in simhash.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    assert simhash.near_duplicates(df.where("doc_id < 0")).count() == 0
    again = simhash.near_duplicates(df.unionByName(df)).collect()
    assert len(again) == 2 * len(rows) and {tuple(r) for r in again} == got
    nulls = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "z")], "doc_id long, text string")
    assert {tuple(r) for r in simhash.near_duplicates(nulls).select("doc_id", "component_id").collect()} == {(None, 5), (5, 5), (None, None)}
