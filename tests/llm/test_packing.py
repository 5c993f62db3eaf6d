import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexweave.llm import packing, ranking

PATH = public_tokenizers.path("byte_bpe_50k.json")


def unroll(bins):
    return [[n for n, k in content for _ in range(k)] for times, content in bins for _ in range(times)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_limit_holds(rule):
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    limits = packing.Limits(100, 5, 6000 + 4000, rule=rule)
    bins = unroll(packing.best_fit(counts, limits))
    assert np.array_equal(np.bincount(sum(bins, []), minlength=101), counts)
    assert all(sum(b) <= 100 and len(b) <= 5 and sum(x * x for x in b) <= 10_000 for b in bins)
    tight = packing.Limits(100, 2, 10_000)
    assert all(len(b) <= 2 for b in unroll(packing.best_fit(counts, tight)))


def test_few_bins():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(rng.geometric(1 / 500, 20_000), 2048), minlength=2049)
    bins = packing.best_fit(counts, packing.Limits())
    used, least = sum(m for m, _ in bins), -(-(counts * np.arange(2049)).sum() // 2048)
    assert used <= 1.01 * least + 1
    assert len(bins) <= 3 * 2048


def test_item_beyond_a_limit():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([0, 0, 1]), packing.Limits(2, 1, 3))


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RUN_ROWS", 3)
    rng = random.Random(3)
    whole = Tokenizer.from_file(PATH)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma\n", "δέλτα"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, "", "x"), (None, "lost", "x"), (5, texts[5], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    limits = packing.Limits(64, 64, 64 * 64)
    got = packing.pack_documents(df, PATH, limits).collect()
    want = []
    for i, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want += [(i or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(w[3] for w in want)
    assert len(by) <= 1.1 * total / 64 + 1
    assert packing.pack_documents(df.where("doc_id < 0"), PATH, limits).count() == 0


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(30)], "doc_id long, text string")
    limits = packing.Limits(32, 32, 32 * 32)
    placed = packing.pack_documents(df, PATH, limits)
    out = packing.sequences(df, placed, PATH).collect()
    assert sum(len(r.ids) for r in out) == sum(r.length for r in placed.collect())
    assert all(len(r.ids) == sum(r.lengths) <= 32 for r in out)
    assert sum(r.ids.count(0) for r in out) == 30
