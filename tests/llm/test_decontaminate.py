import random

import numpy as np

from lexweave.llm import decontaminate as dc

VOCAB = [f"w{i:x}" for i in range(3000)]


def brute_score(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 15))] for _ in range(2))
        assert dc.smith_waterman(np.array(a, int), np.array(b, int))[0] == brute_score(a, b)


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice(VOCAB) if x < 2 * rate / 3 else w)
        if 2 * rate / 3 < x < rate:
            out.append(rng.choice(VOCAB))
    return out


def test_planted_items(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    items = {k: say(rng.randrange(20, 60)) for k in range(12)}
    docs, want = [], set()
    for i in range(150):
        words = say(rng.randrange(0, 300))
        if i % 3 == 0:
            k = rng.randrange(12)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if i % 2 else w + "," for w in (items[k] if i % 2 else edited(rng, items[k], 0.3))]
            if brute_score(items[k], [w.strip(",").lower() for w in words]) >= len(items[k]):
                want.add((i, k))
        docs.append((i, " ".join(words), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, " ".join(items[3]), "x"), (0, docs[0][1], "x"), (502, " ".join(say(20_000) + items[5] + say(20_000)), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(50, "w1 w2"), (51, None), (None, "")], "item_id long, text string")
    want |= {(None, 3), (502, 5)}
    for limit in (dc.BLOCK_WORDS, 100):
        got = dc.find_leaks(df, bench, [df.doc_id], block_words=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert sum(r.doc_id == 0 for r in got) == 2
        by_doc = {d[0]: d[1] for d in docs}
        for r in got:
            if r.doc_id is not None and r.doc_id < 500:
                words = [w.strip(",").lower() for w in by_doc[r.doc_id].split()]
                assert r.score == brute_score(items[r.item_id], words) / (2 * len(items[r.item_id]))
    left = dc.decontaminate(df, bench)
    assert left.columns == df.columns
    leaked = {d for d, _ in want}
    assert {r.doc_id for r in left.collect()} == {d[0] for d in docs} - leaked
    assert dc.find_leaks(df, bench.where("item_id > 1000"), [df.doc_id]).count() == 0
    assert dc.find_leaks(df.where("doc_id > 1000"), bench, [df.doc_id]).count() == 0
