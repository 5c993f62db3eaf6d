import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexweave.llm.bytesets import frugal
from lexweave.llm.tokens import ChunkEncoder, _encoders, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["word", "Word,", "end.", "it's", "été", "ÉTÉ", "naïve.", "日本語", "\U0001f600", "1234", "a-b", "...", "!?", "<|endoftext|>", "$5", "x" * 100, "İ", "ß", "don't.", "'s", "ǅ", "ĳ", "ª", "\x00", "﻿", "é"]
GAPS = [" "] * 12 + ["\n", "  ", " \n", "\n ", "\t", "\xa0", " \xa0", "　", "\x85", "  ", "\r\n", "", "\n\n", "\x1c"]


@pytest.mark.parametrize("remembered", [8, 1000])
def test_equals_the_library(remembered):
    assert sys.byteorder == "little"
    whole = Tokenizer.from_file(PATH)
    mine = ChunkEncoder(PATH, remembered)
    rng = random.Random(1)
    texts = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n", "\na", "a \n b", "of.\nThe", "of.\n\nThe", "a,\nb", "a.\n"]
    for _ in range(3000):
        texts.append("".join(rng.choice(BITS) + rng.choice(GAPS) for _ in range(rng.randrange(12))))
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


MARKED = ["word,", "word.", "w1,", "1.", "word!!", "été...", "a'", "a',", "日本,", ",", ".", ".,", "a.,", "###,", "\x1c", "\x1d", "a\x1c", "_,", "ß.", "ª,", "x-y.", "a.b,", "a,b.", "é,", "it's.", "a.\nB,", "a!!\nB.", "<|endoftext|>,"]


@pytest.mark.parametrize("remembered", [8, 1000])
def test_marks_equal_the_library(remembered):
    whole = Tokenizer.from_file(PATH)
    mine = ChunkEncoder(PATH, remembered)
    rng = random.Random(2)
    texts = [", a", ". a", "a, ", "a. ", "a, , b", "a. . b", " \x1c a", "a \x1c b", "a \x1d b, c", "a,  b"]
    texts += ["a.\n\nb", "a.\nb,\nc. d", "\n", "\na. b", "a. b.\n", ".\na", ",\n. b", "a\n,\nb", "a\n, b", "a,\n\n. b", "a b.\nc.\n\nd"]
    for odd in (0, 3):  # few odd bits leave most texts printable
        some = MARKED if odd else [m for m in MARKED if m.isprintable()][:6] + ["it's.", "x-y."]
        texts += ["".join(rng.choice(some) + rng.choice("    \n") for _ in range(rng.randrange(1, 12))).rstrip(" ") for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_only_letters_and_marks_reach_the_library():
    """Words with marks behind them are made of parts that are known, so each part is asked for once."""
    mine = ChunkEncoder(PATH)
    asked = []
    for memo in (mine._first, mine._spaced):
        memo.encode = lambda t, f=memo.encode, **more: asked.append(t) or f(t, **more)
    for t in ("word, other. word!! other!! été!! word,", "word!!, b", "été### other###"):
        assert mine.encode(t)
    assert sorted(asked) == ["!!", "!!,", "###"]


def test_added_tokens_across_a_border(tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.add_tokens(["ab!"])
    tokenizer.save(f"{tmp_path}/t.json")
    mine = ChunkEncoder(f"{tmp_path}/t.json")
    for t in ("ab!! c", "x ab! c, d"):
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encoders_go_when_another_operator_runs():
    for keeps, left in ((True, [PATH]), (False, [])):
        encoder(PATH).encode("some words")
        seen = []
        list(frugal(lambda batches: seen.extend(_encoders) or batches, keeps)(iter([])))
        assert seen == left and list(_encoders) == left
