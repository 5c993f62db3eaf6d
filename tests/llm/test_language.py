import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import language as L

WORDS = {"en": "the of and that with from this house river tion ing", "fr": "le la des que une dans être pour avec oiseau", "de": "der die und nicht über mit schön straße ist ein"}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_automaton_reads_substrings_only():
    rng = random.Random(1)
    for _ in range(30):
        s = [rng.randrange(3) for _ in range(30)]
        states = L.suffix_automaton(np.array(s))
        subs = {tuple(s[i:j]) for i in range(30) for j in range(i + 1, 31)}
        for _ in range(200):
            x = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 8)))
            at = 0
            for c in x:
                at = states[at].get(c)
                if at is None:
                    break
            assert (at is not None) == (x in subs)


def phrases(train, x):
    """Brute force: the longest prefix of what is left that lies in train, again and again."""
    n = 0
    while x:
        k = 1
        while k < len(x) and x[: k + 1] in train:
            k += 1
        n, x = n + 1, x[k:]
    return n


@pytest.mark.parametrize("stretch", [7, 100, 1024])
def test_phrase_counts_against_brute_force(monkeypatch, stretch):
    """One parse of the whole text, whatever the stretches that are parsed side by side."""
    monkeypatch.setattr(L, "STRETCH", stretch)
    rng = random.Random(2)
    model = L.Model({k: text(rng, k, 40) for k in WORDS})
    texts = [text(rng, rng.choice(list(WORDS)), rng.randrange(1, 60)) for _ in range(20)] + ["", "123", "日本語 です", text(rng, "en", 900), model.texts["fr"] * 3, "de de " * 500]
    names = model.tables()[0]
    sym = lambda t: "".join(map(chr, L.symbols(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]))
    for _, data, offsets in L.blocks(pa.array(texts)):
        bits = model.entropy(data, offsets)
        for i, t in enumerate(texts):
            s = sym(t)
            for j, n in enumerate(names):
                want = phrases(sym(model.texts[n]), s)
                got = bits[i, j] * max(1, len(s)) / np.log2(len(model.texts[n].encode()))
                assert round(got) == want


def test_tables_lie_in_memory_once():
    rng = random.Random(3)
    model = L.Model({k: "".join(chr(rng.randrange(97, 123)) for _ in range(3000)) for k in "abcdefgh"})
    tracemalloc.start()
    table = model.tables()[2]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert table.dtype == np.int32
    assert peak < 12 * table.size, peak  # with an automaton; two tables of 64 bits would take 16


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang := rng.choice(list(WORDS)), rng.randrange(5, 80)), lang, "x") for i in range(300)]
    rows += [(400, None, "en", "x"), (401, "", None, "x"), (402, "12 34 !", "en", "x"), (403, "日本", None, "x"), (404, text(rng, "fr", 3000), "fr", "x"), (None, text(rng, "de", 30), "de", "x"), (7, rows[7][1], rows[7][2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = L.identify_documents(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (400, 401, 402))
    assert by[403].lang_pred in WORDS and by[404].lang_pred == "fr" and by[None].lang_pred == "de" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    right = [by[r[0]].lang_pred == r[2] for r in rows[:300] if by[r[0]].held_out]
    assert sum(right) / len(right) > 0.97
    flipped = df.withColumn("lang", F.when(L.held_out(), F.lit("en")).otherwise(F.col("lang")))
    assert sorted(map(str, L.identify_documents(flipped).collect())) == sorted(map(str, got))
    assert L.identify_documents(df.where("doc_id < 0")).count() == 0
    assert {r.lang_pred for r in L.identify_documents(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
