"""Language identification by cross-parsing entropy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .bytesets import blocks, frugal
from .durable import columns_like, durable

UNKNOWN = "und"
#: The bound of the training sample: whole texts per language, and characters that they may have together.
SAMPLE_TEXTS, SAMPLE_CHARS = 32, 32_768
#: Texts of so many characters teach best: long enough to hold much, short enough to take many.
SAMPLE_LENGTHS = (200, 4_096)
#: Languages that a model may hold; more labels than this are an error, not cut.
MAX_LANGUAGES = 200
#: A text is parsed in stretches of so many symbols side by side, then again where a phrase crosses their border.
STRETCH = 1024
#: Byte classes: letters a-z, one class for every other ASCII byte, and each byte of longer UTF-8 sequences.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
N_CLASSES = 155


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, offsets) of each row, where runs of class 0 are one symbol."""
    classes = _CLASS[data]
    keep = classes != 0
    keep[1:] |= classes[:-1] != 0
    place = np.concatenate(([0], np.cumsum(keep)))
    return classes[keep], place[offsets]


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions by state of the automaton that reads exactly the substrings of ``text``."""
    nxt: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text.tolist():
        cur, p = len(nxt), last
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


@dataclass
class Model:
    """Labelled text per language; the automata are built where the model is used."""

    texts: dict[str, str]
    _tables: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"texts": self.texts, "_tables": None}

    def tables(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, int]:
        """(languages, class map, transitions, first state of each, classes).

        A transition is four times the next state's place, plus the phrases that
        end: one where a phrase could not go on with this symbol, and one more
        for a symbol that the language lacks, which is a phrase by itself. They
        have 32 bits where that is enough for all places, as every worker holds
        the table.
        """
        if self._tables is None:
            names = sorted(self.texts)
            read = []
            for name in names:
                raw = np.frombuffer(self.texts[name].encode(), np.uint8)
                read.append(symbols(raw, np.array([0, len(raw)]))[0])
            seen = np.unique(np.concatenate(read)) if read else np.zeros(0, np.uint8)
            wide = len(seen) + 1  # the last class: never seen
            squeeze = np.full(N_CLASSES, wide - 1, np.int32)
            squeeze[seen] = np.arange(len(seen))
            # an automaton has fewer than two states a symbol, and the first
            places = wide * sum(2 * len(text) + 1 for text in read)
            kind = np.int32 if 4 * places + 2 <= np.iinfo(np.int32).max else np.int64
            parts, firsts, base = [], [], 0
            for text in read:
                states = suffix_automaton(squeeze[text])
                root = np.full(wide, 0, np.int64)
                for c, i in states[0].items():
                    root[c] = i
                anew = (4 * (base + root * wide) + (root == 0)).astype(kind)
                table = np.tile(anew + 1, (len(states), 1))
                table[0] = anew
                for k, moves in enumerate(states):
                    for c, i in moves.items():
                        table[k, c] = 4 * (base + i * wide)
                parts.append(table.reshape(-1))
                firsts.append(base)
                base += len(states) * wide
            whole, at = np.empty(base, kind), 0
            while parts:  # one by one, so that the table never lies in memory twice
                part = parts.pop(0)
                whole[at : at + len(part)] = part
                at += len(part)
            self._tables = names, squeeze, whole, np.array(firsts, np.int64), wide
        return self._tables

    def entropy(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits a symbol of each row under each language: phrases times log2 of the language's text, by length.

        Every stretch of a text is first parsed as if a phrase began there.
        Then those stretches whose predecessor ends inside a phrase are parsed
        again from that state, until no state changes; as parses of the same
        symbols soon agree, that is rarely more than once. The count is that
        of one parse of the whole text.
        """
        names, squeeze, table, firsts, _ = self.tables()
        classes, offsets = symbols(data, offsets)
        codes = squeeze[classes].astype(np.int64)
        lengths = np.diff(offsets)
        per = -(-lengths // STRETCH)
        row = np.repeat(np.arange(len(lengths)), per)
        begin = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * STRETCH
        size = np.minimum(offsets[row + 1] - begin, STRETCH)
        n, k = len(row), len(names)

        def parse(begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(phrases that end, last state) of stretches from given states, a row for each or a row by language."""
            order = np.argsort(-size, kind="stable")
            begin, size, state = begin[order], size[order], state[order]
            cuts, live = np.zeros(state.shape, np.int64), len(begin)
            for t in range(int(size[0]) if live else 0):
                while size[live - 1] <= t:
                    live -= 1
                at = codes[begin[:live] + t]
                step = table[state[:live] + (at[:, None] if state.ndim > 1 else at)]
                cuts[:live] += step & 3
                state[:live] = step >> 2
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            return cuts[back], state[back]

        start = np.repeat(firsts[None, :], n, axis=0)
        cuts, end = parse(begin, size, start)
        follows = np.flatnonzero(row[1:] == row[:-1]) + 1  # stretches with one of the same text before them
        while True:
            at, lang = np.nonzero(end[follows - 1] != start[follows])
            if not at.size:
                break
            at = follows[at]
            start[at, lang] = end[at - 1, lang]
            cuts[at, lang], end[at, lang] = parse(begin[at], size[at], start[at, lang])
        last = np.ones(n, bool)
        last[follows - 1] = False
        cuts += (end != firsts[None, :]) & last[:, None]
        phrases = np.zeros((len(lengths), k), np.int64)
        np.add.at(phrases, row, cuts)
        scale = np.array([math.log2(max(2, len(self.texts[x].encode()))) for x in names])
        return phrases * scale / np.maximum(lengths, 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """(language, score) of each text; score: how far the best entropy lies below the second, 0 to 1."""
        names = self.tables()[0]
        langs, scores = [], []
        for at, data, offsets in blocks(texts):
            bits = self.entropy(data, offsets)
            letters = np.concatenate(([0], np.cumsum((_CLASS[data] > 0) & (_CLASS[data] < 27))))[offsets]
            for i in range(len(offsets) - 1):
                lettered = letters[i + 1] > letters[i] or any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
                if not lettered or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                by = np.argsort(bits[i], kind="stable")
                best, second = bits[i][by[0]], bits[i][by[min(1, len(by) - 1)]]
                langs.append(names[by[0]])
                scores.append(1.0 if len(by) == 1 else float(1 - best / second) if second > 0 else 0.0)
        return langs, scores


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from a bounded sample of rows: at most ``sample_texts`` distinct whole texts per language.

    Texts within SAMPLE_LENGTHS come first, by the least hash, then others, the
    shortest first; texts are taken while they have ``sample_chars`` characters
    together at most. Rows with a null or empty text or a null language teach
    nothing, nor does a language of which every text is longer than
    ``sample_chars``. The sample does not depend on the order of rows or on how
    often a text repeats.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and length(text) > 0").withColumn("h", F.xxhash64("text"))
    low, high = SAMPLE_LENGTHS
    size = F.length("text")
    hashes = durable(rows.where(size <= sample_chars).select("lang", "h", size.alias("n")).distinct(), "language-hashes")
    names = hashes.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if names > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    # ranks beyond the limit are dropped in each task before the shuffle, so no language is gathered
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.when(F.col("n").between(low, high), 0).otherwise(F.col("n")), "h"))
    ranked = hashes.withColumn("place", place).where(F.col("place") <= sample_texts)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("place"))
    chosen = ranked.withColumn("upto", before).where(F.col("upto") <= sample_chars).select("lang", "h")  # at most MAX_LANGUAGES * sample_texts rows
    picked = rows.join(F.broadcast(chosen), ["lang", "h"])
    samples = picked.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(samples, key=lambda r: (r["lang"], r["h"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model({k: "\n".join(v) for k, v in texts.items()})


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[Column] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with the predicted language and its score.

    Whole texts are parsed. The language is ``und`` (score 0) where the text is
    null or has no letter, or where the model knows no language.
    """
    kept = docs.select(*keep)
    source = docs.select(*keep, F.col(text).cast("string").alias(*columns_like(kept, "text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1].fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], *names])

    return source.mapInArrow(frugal(run), f"{schema}, {names[0]} string, {names[1]} double")


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; learnt from the rows that are not held out."""
    model = fit(docs.where(~held_out(id_col)), text, lang)
    return identify(docs, model, text, [F.col(id_col), held_out(id_col).alias("held_out")])
