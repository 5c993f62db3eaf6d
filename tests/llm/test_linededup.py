import random

import numpy as np
import pyarrow as pa

from lexweave.llm import linededup as ld
from lexweave.llm.bytesets import blocks

VOCAB = [f"w{i:x}" for i in range(5000)] + ["été", "Straße", "日本"]


def line(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n)) + rng.choice([".\n", ". ", "!\n", "\n"])


def squeeze(s):
    return "".join(s.split()).lower()


def cut(text):
    """Brute-force lines."""
    out, held = [], ""
    for i, c in enumerate(text):
        held += c
        if c == "\n" or (c == " " and i and text[i - 1] in ".!?"):
            if held.split() or not out:
                out.append(held)
            else:
                out[-1] += held
            held = ""
            if len(out) == 1 and not out[0].split():
                held, out = out[0], []
    if held:
        if held.split() or not out:
            out.append(held)
        else:
            out[-1] += held
    return [x for x in out if x.split()]


def test_lines_against_brute_force():
    rng = random.Random(1)
    texts = ["", " ", "\n\n", "a", "\n a", "a\n\n", "a. b", "a.b", "a! \n b?c? d"] + ["".join(rng.choice(["a", "é", "b", ". ", "\n", " ", "?", "! "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    for limit in (1, 50, 1 << 20):
        got = []
        for _, data, offsets in blocks(pa.array(texts), limit):
            starts, count, first = ld.lines(data, offsets)
            for i in range(len(offsets) - 1):
                own = starts[first[i] : first[i + 1]]
                ends = np.append(own[1:], offsets[i + 1])
                got.append([bytes(data[a:b]).decode() for a, b in zip(own, ends)])
                assert count[first[i] : first[i + 1]].tolist() == [len(bytes(data[a:b]).split()) for a, b in zip(own, ends)]
        for t, g in zip(texts, got):
            assert g == cut(t), repr(t)


def test_equal_runs_share_a_fingerprint():
    rng = random.Random(2)
    for trial in range(60):
        shared = [line(rng, rng.randrange(1, 25)) for _ in range(12)]
        while sum(len(x.split()) for x in shared[:-1]) >= 40:
            shared.pop()
        if sum(len(x.split()) for x in shared) < 40:
            continue
        texts = ["".join([line(rng, rng.randrange(1, 20)) for _ in range(rng.randrange(5))] + shared + [line(rng, rng.randrange(1, 20)) for _ in range(rng.randrange(5))]) for _ in range(2)]
        # the run must begin and end with whole lines
        texts = [t.replace(shared[0], "\n" + shared[0], 1) for t in texts]
        prints = []
        for _, data, offsets in blocks(pa.array(texts)):
            *_, first, at, size, h = ld.fingerprints(data, offsets)
            row = np.searchsorted(first, at, "right") - 1
            prints = [set(h[row == k].tolist()) for k in (0, 1)]
        assert prints[0] & prints[1]


def kept_text(text, runs):
    out, at = "", 0
    for r in sorted(runs, key=lambda r: r.start):
        out += text[at : r.start]
        at = len(text) if r.stop is None else r.stop
    return out + text[at:]


def test_planted_passages(spark):
    rng = random.Random(3)
    passages = [[line(rng, rng.randrange(8, 20))[:-1].rstrip() + "\n" for _ in range(6)] for _ in range(4)] + [[" ".join(rng.choice(VOCAB) for _ in range(60)) + "\n"]]
    own, texts = {}, {}
    for i in range(60):
        parts = [line(rng, rng.randrange(3, 30)).rstrip() + "\n" for _ in range(rng.randrange(2, 12))]
        own[i] = list(parts)
        if i % 2:
            k = rng.randrange(len(passages))
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = passages[k]
        texts[i] = "".join(parts)
    texts[70] = texts[1]
    texts[71] = ""
    texts[72] = None
    rows = [(i, t, "x") for i, t in texts.items()] + [(3, texts[3], "again"), (None, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {}
    for r in ld.removed_lines(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = set()
    for i in sorted(k for k in texts if texts[k]):
        rest = kept_text(texts[i], set(got.get(i, [])))
        for p in passages:
            whole = squeeze("".join(p))
            if whole in squeeze(texts[i]):
                assert (whole in squeeze(rest)) == (whole not in seen)
                seen.add(whole)
        if i in own and i < 70:
            assert squeeze("".join(own[i])) in squeeze(rest) or any(squeeze("".join(p)) in squeeze(rest) for p in passages)
    assert kept_text(texts[70], set(got[70])) == ""
    assert not [i for i in range(0, 60, 2) if i in got] and None not in got
    out = {(r.doc_id, r.runs): r.text for r in ld.drop_repeated_lines(df).collect()}
    assert (70, "x") not in out and out[(72, "x")] is None and out[(71, "x")] == "" and out[(None, "x")] == "short"
    for i in texts:
        if texts[i] and i != 70:
            assert out[(i, "x")] == kept_text(texts[i], set(got.get(i, [])))
    assert out[(3, "again")] == out[(3, "x")]
    assert ld.drop_repeated_lines(df).columns == df.columns
    assert ld.removed_lines(df.where("doc_id > 1000")).count() == 0


def test_every_deleted_line_stays_somewhere(spark):
    rng = random.Random(4)
    bank = [line(rng, rng.randrange(1, 12)).rstrip() + "\n" for _ in range(25)]
    texts = {i: "".join(rng.choice(bank) for _ in range(rng.randrange(1, 60))) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = {r.doc_id: r.text for r in ld.drop_repeated_lines(df).collect()}
    have = {x for t in kept.values() for x in cut(t)}
    assert {x for t in texts.values() for x in cut(t)} <= have
    assert sum(map(len, kept.values())) < sum(map(len, texts.values()))


def test_stretches_inside_endless_lines(spark):
    """Shared stretches of 60 words that begin and end in the midst of a line, with no line feed or sentence end anywhere."""
    rng = random.Random(5)
    say = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    shared = [say(60) for _ in range(10)]
    texts, clean = {}, {}
    for i in range(80):
        before, after = say(rng.randrange(5, 90)), say(rng.randrange(5, 90))
        if i % 4 == 3:
            clean[i] = texts[i] = " ".join(before + after)
        else:
            texts[i] = " ".join(before + shared[i % 10] + after)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in ld.drop_repeated_lines(df).collect()}
    assert set(kept) == set(texts) and all(kept[i] == t for i, t in clean.items())
    seen = set()
    for i in sorted(kept):
        words = kept[i].split()
        windows = {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        assert not windows & seen
        seen |= windows
    assert all(" ".join(s) in texts[i] and any(" ".join(s) in t for t in kept.values()) for i, s in enumerate(shared) if i % 4 != 3)
