import math
import random
import re
from collections import Counter

from lexweave.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def chars(text):
    text = text or ""
    out = [0] * 9
    for c in text:
        k = 0 if c in " \t\n\x0b\x0c\r" else 1 if c == "|" else 2 if c in "<>" else 3 if c in Q.SYMBOLS else 4 if c in "0123456789" else 5 if "A" <= c <= "Z" else 6 if c in ".,;:!?'\"()-" else 7 if ord(c) > 127 else 8
        out[k] += 1
    return out


def distance(p, q):
    sp, sq = sum(p), sum(q)
    if not sp or not sq:
        return 0.0
    out = 0.0
    for a, b in zip(p, q):
        a, b = a / sp, b / sq
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(out, 0))


def test_against_brute_force(spark):
    rng = random.Random(1)
    plain = Q.COMMON_WORDS["en"] + [f"word{i}" for i in range(40)]

    def say(n):
        return " ".join(rng.choice(plain) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))

    rows = [(i, say(rng.randrange(0, 200)), "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "a b c d e a b c d e", "en"), (103, "x " * 300, "EN"), (104, " a\x85b c\x1cd\n\n\nc\nc\n \nc", "fr"), (105, "#$% " * 80, "en"), (109, " | ".join(say(120).split()), "en"), (110, " <b> ".join(say(120).split()), "en"), (106, say(4000), "xx"), (None, say(60), "en"), (5, rows[5][1], "en"), (107, "a b c d e f a b c d e f g a b c d e", None), (108, "é ü #\r\n" * 20, "de")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, words string")
    got = Q.judge(df).collect()
    assert len(got) == len(rows)
    ref, most = {}, max(len(v) for v in Q.COMMON_WORDS.values())
    lists = lambda lang: Q.COMMON_WORDS.get((lang or "").lower(), [])

    def hist(text, lang):
        words = [w.lower() for w in WORD.findall(text or "") if len(w) <= 5]
        out = [words.count(c) for c in lists(lang)]
        return out + [0] * (most - len(out)) + [base(text)[0] - sum(out)]

    fails = lambda t: base(t)[0] < 10 or 100 * base(t)[-1] > 20 * base(t)[0]
    passing = Counter((lang or "").lower() for _, text, lang in rows if not fails(text))
    assert passing["en"] >= Q.LEAST_DOCUMENTS > passing["fr"]
    for _, text, lang in rows:
        c, w = ref.setdefault((lang or "").lower(), ([0] * 9, [0] * (most + 1)))
        if fails(text) or passing[(lang or "").lower()] < Q.LEAST_DOCUMENTS:
            continue
        for k, x in enumerate(chars(text)):
            c[k] += x
        for k, x in enumerate(hist(text, lang)):
            w[k] += x

    want = []
    for i, text, lang in rows:
        n, *rest = base(text)
        failed = n < 10 or 100 * rest[-1] > 20 * n
        c, w = ref[(lang or "").lower()]
        dc, dw = distance(chars(text), c), distance(hist(text, lang), w)
        want.append((i if i is not None else -1, n, *rest, failed, dc, dw, not failed and (n < 50 or (dc <= Q.CHARS_BEYOND and dw <= Q.WORDS_BEYOND))))
    mine = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got)
    assert [(*r[:7], r[9]) for r in mine] == [(*r[:7], r[9]) for r in sorted(want)]
    assert all(abs(a - b) < 2e-6 for r, w in zip(mine, sorted(want)) for a, b in zip(r[7:9], w[7:9]))
    assert Q.judge(df.where("doc_id < 0")).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    plan = Q.judge(df)._jdf.queryExecution().toString() + Q.measure(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
