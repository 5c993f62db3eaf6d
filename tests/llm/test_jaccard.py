import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lexweave.llm import jaccard
from lexweave.llm.bytesets import blocks

VOCAB = [f"w{i:x}" for i in range(2000)]


def brute_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute_components(rows):
    sets = [(i, brute_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (a == b or 5 * len(a & b) >= 4 * len(a | b)) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_sets_against_brute_force():
    rng = random.Random(1)
    texts = ["", None, " \n", "one", "One two", "a b c d e", "a b c d e f", "x " * 30] + ["".join(rng.choice(["The", "été", "a", "日本"]) + rng.choice([" ", "\n", "\t "]) for _ in range(rng.randrange(40))) for _ in range(60)]
    for limit in (1, 100, 1 << 20):
        sizes, hashes = [], []
        for _, data, offsets in blocks(pa.array(texts), limit):
            values, cut = jaccard.shingle_sets(data, offsets)
            sizes += np.diff(cut).tolist()
            hashes += jaccard.set_hashes(values, cut).tolist()
        sets = [brute_set(t) for t in texts]
        assert sizes == [len(s) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                assert (hashes[i] == hashes[j]) == (sets[i] == sets[j])


@pytest.mark.parametrize("tile", [2, 2048])
def test_documents_against_brute_force(spark, tile):
    rng = random.Random(2)
    say = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    rows, common = [], say(12)
    base = [say(n) for n in (5, 9, 14, 20, 20, 60, 200, 700)] + [common + say(20) for _ in range(6)]
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(1 + max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = rng.choice(VOCAB)
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    chain = say(100)  # each like the next, the first unlike the last
    for k in range(12):
        chain = chain[4:] + say(4)
        rows.append((200 + k, " ".join(chain)))
    rows += [(300, None), (301, ""), (302, "\n"), (303, "solo"), (304, "Solo")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sig string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, tile=tile).collect()}
    want = brute_components(rows)
    assert got == want
    assert len(set(want.values())) < len(want) - 60 and got[211] == 200
    assert jaccard.near_duplicates(df.where("doc_id < 0")).count() == 0
    assert jaccard.near_duplicates(df.unionByName(df), tile=tile).count() == 2 * len(rows)


def test_stage_drops_near_copies(spark):
    """Short texts that line dedup leaves whole: one word in 20 to 60 is changed."""
    rng = random.Random(3)
    rows = []
    for k in range(30):
        words = [rng.choice(VOCAB) for _ in range(20 + k)]
        rows += [(k, " ".join(words)), (100 + k, " ".join([*words[:-1], "changed"]))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == set(range(30))


def test_fingerprints_find_candidates(spark, monkeypatch):
    """The stage of the pipeline compares SimHash fingerprints of five-word shingles; none within the radius is lost."""
    rng = random.Random(5)
    base = [rng.choice(VOCAB) for _ in range(1500)]
    texts = ["", "one"]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(1500)] = "edited"
        texts.append(" ".join(words))
    (_, data, offsets), = blocks(pa.array(texts))
    values, cut = jaccard.shingle_sets(data, offsets)
    sig = jaccard.set_hashes(values, cut).tolist()
    fp = jaccard.simhash.majority(values.view(np.uint64), np.diff(cut))
    for k in range(len(texts)):
        members = [int(v) & (1 << 64) - 1 for v in values[cut[k] : cut[k + 1]]]
        assert int(fp[k]) == sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in members) > len(members))
    asked = []
    links = jaccard.simhash.links
    monkeypatch.setattr(jaccard.simhash, "links", lambda prints, *more: asked.append(prints) or links(prints, *more))
    sets = spark.createDataFrame([(int(f), s) for f, s in zip(fp.view(np.int64), sig)], "fp long, sig long")
    got = [(r.a, r.b) for r in jaccard.fingerprint_pairs(sets).collect()]
    root = {s: s for s in sig}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    print_of = dict(zip(sig, fp))
    for a, b in got:
        assert a < b
        root[max(find(a), find(b))] = min(find(a), find(b))
    near = [(a, b) for a in print_of for b in print_of if a < b and int(print_of[a] ^ print_of[b]).bit_count() <= 2]
    assert len(near) > 20 and all(find(a) == find(b) for a, b in near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(asked) == 1
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert len(asked) == 2 and {r.fp for r in asked[1].collect()} == set(fp.view(np.int64).tolist())
    assert kept == set(brute_components(list(enumerate(texts))).values())
