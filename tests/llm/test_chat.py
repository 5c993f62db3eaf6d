import hashlib

import pytest

from lexweave.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|done|>", "\\", "\\\\<|", "<\\|done|>", "<", "a<", "[", "[/INST", "<<SYS>>\n<</SYS>>", "", None, "é\r\n\U0001f600", "$1 \\1"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        yield c, len(turns), sha(said), len(loss), sha(loss)


def test_round_trip(spark):
    rows = [(i, k, role, x) for i, x in enumerate(ODD) for k, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(100, k, "assistant" if k % 2 else "user", ODD[k % len(ODD)]) for k in range(60)]
    rows += [(101, 0, "user", "no answer"), (102, 0, "assistant", "first"), (102, 1, "user", "last"), (103, 0, None, None), (104, None, "assistant", "x"), (104, 0, "assistant", "x"), (104, 0, "assistant", "x"), (None, 0, "assistant", "lost"), (105, 0, "<|says|>", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df)
    got = {tuple(r)[:5] for r in chat.digest(examples).collect()}
    assert got == set(brute(rows))
    n = examples.where("target is not null").count()
    assert n == sum(1 for r in rows if r[2] == "assistant")
    for r in examples.where("conv_id = 100").collect():
        shown = r.formatted
        assert shown.count(chat.OPEN) == (r.target or 59) + 1
        assert shown.endswith(chat.CLOSE) and shown[r.loss_start + r.loss_length :] == chat.CLOSE


def test_no_mark_inside_texts(spark):
    df = spark.createDataFrame([(x,) for x in ODD if x], "x string")
    for raw, safe, back in df.select("x", chat.escape(df.x), chat.unescape(chat.escape(df.x))).collect():
        assert raw == back
        assert not any(m in safe for m in (chat.OPEN, chat.HEAD, chat.CLOSE, *chat.FOREIGN))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.expand(df)).count() == 0


@pytest.mark.parametrize("extra", ["formatted", "turns", "at"])
def test_clashing_columns(spark, extra):
    df = spark.createDataFrame([(1, 0, "assistant", "x", "y")], f"conv_id long, turn long, role string, text string, {extra} string")
    assert chat.digest(chat.expand(df)).count() == 1
