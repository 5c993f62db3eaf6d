import math
import random
import re
from collections import Counter

from lexweave.llm import licenses as L

TEXTS = {"A": ("Licensed under the alpha license version 2", "alpha license"), "B": ("released under beta terms",), "C": ("all rights reserved",)}
WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def brute(docs, texts, least):
    words = [WORD.findall((t or "").lower()) for t in docs]
    n = len(docs)
    df = Counter(w for d in words for w in set(d))
    templates = [(k, Counter(WORD.findall(t.lower()))) for k, ts in texts.items() for t in ts]
    vocabulary = {w for _, c in templates for w in c}
    idf = lambda w: math.log((n + 1) / ((df[w] if w in vocabulary else 0) + 1)) + 1
    vec = lambda c: {w: k * idf(w) for w, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def cosine(line, t):
        c = Counter(WORD.findall(line))
        inside = {w: k for w, k in c.items() if w in vocabulary}
        length = math.sqrt(norm(vec(inside)) ** 2 + sum(k for w, k in c.items() if w not in vocabulary) * idf("") ** 2)
        v = vec(t)
        return sum(vec(inside).get(w, 0) * x for w, x in v.items()) / (length * norm(v)) if length else 0

    out = []
    for text in docs:
        best = max((cosine(line, c) for line in (text or "").lower().split("\n") for _, c in templates), default=0)
        out.append(best)
    return out


def test_lines_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    noise = "the of foo bar baz qux license under".split()
    docs = []
    for i in range(60):
        lines = [" ".join(rng.choice(noise) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["LICENSED under the Alpha license, version 2", "Released under beta terms.", "All rights reserved", "alpha license"]))
        docs.append("\n\n".join(lines))
    docs += [None, "", "été\nall rights\nreserved\n"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in L.detect(df, [df.doc_id], least=0.8, texts=TEXTS).collect()}
    want = brute(docs, TEXTS, 0.8)
    assert len(got) == len(docs)
    for i, best in enumerate(want):
        if best >= 0.8 + 1e-6:
            assert got[i].licence is not None and got[i].score >= best - 1e-5
    assert got[62].licence == "C"  # a header over two lines
    assert [got[i].licence for i in (60, 61)] == [None, None]
    for i in range(60):
        if got[i].licence is not None:
            assert got[i].score >= 0.8
        if i % 3 == 0:
            assert got[i].licence is not None


def test_templates(spark):
    rows = [(i, f"some words before\n{t.upper()}\nand after it", k) for i, (k, t) in enumerate((k, t) for k, ts in L.TEMPLATES.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = L.detect(df, [df.doc_id, df.want]).collect()
    assert [(r.want, r.line) for r in got] == [(r.licence, r.line) for r in got] and len(got) == len(rows)


def test_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("a/LICENSE", mit), ("a/x.py", "code"), ("a/b/y.py", "code"), ("a/b/c/LICENSE.txt", apache), ("a/b/c/z.py", None), ("a/b/c/d/e/w.py", ""), ("a/b/c/own.py", f"{mit}\ncode"), ("other/x", "code"), (None, "code"), ("a/b/c/COPYING", mit),
        ("//a//x2.py", "code"), ("a/x.py", "code"), ("ab/x", "code"),
    ]
    df = spark.createDataFrame([(i, p, t, "k") for i, (p, t) in enumerate(rows)], "id long, path string, text string, dir__ string")
    got = {r.id: (r.licence, r.origin, r.licence_path) for r in L.scan_licences(df, df.path, [df.id]).collect()}
    assert len(got) == len(rows)
    assert got[1] == got[2] == got[11] == got[10] == ("MIT", "inherited", "a/LICENSE")
    assert got[4][1] == got[5][1] == "inherited" and got[4] == got[5] and got[4][2] in ("a/b/c/COPYING", "a/b/c/LICENSE.txt")
    assert got[6] == ("MIT", "own", "a/b/c/own.py")
    assert got[7] == got[8] == got[12] == (None, "none", None)
    assert L.scan_licences(df.where("id < 0"), df.path, [df.id]).count() == 0
