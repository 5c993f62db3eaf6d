"""Token ids by the tokenizers library, remembered chunk by chunk."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from .bytesets import KEPT

#: Distinct words that one worker remembers, about 200 bytes each, in two generations.
REMEMBERED = 800_000
#: Longer chunks are encoded but not remembered.
LONG = 64


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Latin letters only: one token of the pre-tokenizer, with or without a space before them.
_LATIN = re.compile(f"[{_LETTERS}]+").fullmatch
#: Latin letters and ASCII marks without the apostrophe: two tokens.
_MARKED = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~]+)").fullmatch
#: What an added token that lies across such a border looks like.
_ACROSS = re.compile(rf"[0-9{_LETTERS}]+[!-/:-@\[-`{{-~]+|.*\n.*", re.S).fullmatch
#: A comma or full stop before a space or line feed, behind anything but a Latin letter or a digit.
_ODD = re.compile(rf"[,.][ \n](?<![0-9{_LETTERS}][,.][ \n])").search
#: What stands for a comma or full stop that is a token apart: printable texts do not hold it, and no chunk begins with white space.
_APART = {",": "\x1c", ".": "\x1d"}
#: The characters that stand for bytes in a byte-level vocabulary: printable ones of Latin-1 for themselves, the others from 256 on.
_SELF = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_CHARS = {b: chr(b) for b in _SELF} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SELF))}
_BYTES = "".join(_CHARS[b] for b in range(256))


class _Memo(dict):
    """Chunk -> ids of ``prefix`` and the chunk; full, it keeps what was used since it was half full."""

    def __init__(self, tokenizer, prefix: str, limit: int):
        self.encode, self.merge, self.prefix, self.limit, self.old = tokenizer.encode, tokenizer.model.tokenize, prefix, limit // 2, {}
        self.bare, self.mark, self.fixed = self, prefix.translate(_BYTES), {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            # letters only leave nothing to cut, so straight to the merges
            if chunk.isascii() and chunk.isalpha():
                ids = array("I", [t.id for t in self.merge(self.mark + chunk)]).tobytes()
            elif _LATIN(chunk):
                found = self.merge(self.mark + chunk.encode().decode("latin-1").translate(_BYTES))
                ids = array("I", [t.id for t in found]).tobytes()
            # letters, marks and a line feed are tokens apart, so only the letters need the library
            elif chunk[-1] in ",." and chunk[:-1].isalpha():
                return self[chunk[:-1]] + self.bare[chunk[-1]]
            elif marked := _MARKED(chunk):
                ids = self[marked[1]] + self.bare[marked[2]]
            else:
                head, feed, tail = chunk.partition("\n")
                if feed and head and tail and not head[-1].isspace() and not tail[0].isspace():
                    return self[head] + self.bare[feed] + self.bare[tail]
                ids = np.array(self.encode(self.prefix + chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= LONG:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
                self.update(self.fixed)
            self[chunk] = ids
        return ids


def _cuts_at_spaces(tokenizer) -> bool:
    """Whether the cuts below hold: byte-level pre-tokenizer with its own pattern, no normalizer, no added token that texts may hold across a space."""
    kind = json.loads(tokenizer.to_str())
    pre = kind.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = any(" " in t["content"] or t["content"].isalpha() or _ACROSS(t["content"]) for t in kind.get("added_tokens") or [])
    return plain and kind.get("normalizer") is None and kind["model"]["type"] == "BPE" and not kind["model"].get("dropout") and not added


def _without_memory(tokenizer) -> None:
    """Replace the model by its like without the library's own memory of words, which is asked for new words only and full early."""
    from tokenizers.models import BPE

    model = json.loads(tokenizer.to_str())["model"]
    kept = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k) is not None}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    tokenizer.model = BPE(model["vocab"], merges, cache_capacity=0, **kept)


class ChunkEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    The pre-tokenizer of such a vocabulary ends a token before every space that
    stands alone between two solid characters, and joins the space to what
    follows. So a text may be cut there, and the ids of a chunk (a word with
    its space and marks) come from the library once and from memory after that.
    Where a space meets other white space there is no cut. A tokenizer that is
    not of this kind is asked for every text as a whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._whole = None if _cuts_at_spaces(tokenizer) else tokenizer
        if not self._whole:
            _without_memory(tokenizer)
        self._first, self._spaced = (_Memo(tokenizer, prefix, remembered * share // 4) for prefix, share in (("", 1), (" ", 3)))
        self._spaced.bare = self._first
        if not self._whole:
            self._spaced.fixed = {stand: self._first[mark] for mark, stand in _APART.items()}
            self._spaced.update(self._spaced.fixed)
            self._feed = self._first["\n"]

    def _line(self, text: str) -> bytes:
        """The ids of a text whose spaces all stand alone between two solid characters."""
        pieces = iter(text.split(" "))
        return self._first[next(pieces)] + b"".join(map(self._spaced.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._whole:
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " not in text and text[0] != " " != text[-1] and "\n " not in text and " \n" not in text and text.replace("\n", "").isprintable():
            # a line feed between two solid characters is a token of its own
            lines = "\n\n" not in text and text[0] != "\n" != text[-1]
            if not _ODD(text):
                for mark, stand in _APART.items():
                    text = text.replace(f"{mark} ", f" {stand} ")
                    text = text.replace(f"{mark}\n", f" {stand}\n") if lines else text
            return self._feed.join(map(self._line, text.split("\n"))) if lines else self._line(text)
        pieces = text.split(" ")
        out, held, memo = [], pieces[0], self._first
        for piece in pieces[1:]:
            if piece and held and not piece[0].isspace() and not held[-1].isspace():
                out.append(memo[held])
                held, memo = piece, self._spaced
            else:
                held += " " + piece
        out.append(memo[held])
        return b"".join(out)


_encoders: dict[str, ChunkEncoder] = {}
KEPT.append(_encoders)


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for the vocabulary file at ``path``; kept from task to task until another operator's."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def size(path: str) -> int:
    """Ids that the vocabulary file at ``path`` has, added tokens among them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return 1 + max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
