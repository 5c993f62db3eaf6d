"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bytesets import RangeHash, U, blocks, frugal, mix
from .durable import columns_like, durable

#: Words of the longest seeds; shorter ones, down to one word, are seeds too.
SEED_WORDS = 3
#: Items of fewer words leak only as they stand, and those shorter than a seed only as a whole document.
LEAST_WORDS = 8
#: Scores of the alignment, in words, and the share of a perfect score that makes a leak.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = 0.5
#: A seed is rare if at most this share of the documents, or RARE_LEAST of them, hold it.
RARE_SHARE, RARE_LEAST = 1 / 20_000, 3
#: Words of benchmark text that one pass over the corpus searches for.
BLOCK_WORDS = 2_000_000
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = _SOLID[128:] = True
_TABLE_BITS = 22
#: Bytes of text that are looked at together: common seeds stand in many items, so hits are many times the words.
STRETCH_BYTES = 1 << 17


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the total) of lower-case texts; words are runs of letters and digits."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _SOLID[data]
    starts, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] = solid[inner + 1]
    ends[inner - 1] = solid[inner]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return RangeHash(data)(starts, ends), np.searchsorted(starts, offsets)


def seed_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size`` - 1 have none."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, U)
    for k in range(size):
        out = mix(out + words[k : k + n])
    return out


class SeedSet:
    """Sorted seed hashes with a bit table before them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(hashes & U((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True

    def find(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``seeds``, places in the set) of those in the set."""
        at = np.flatnonzero(self.table[(seeds & U((1 << _TABLE_BITS) - 1)).astype(np.int64)])
        if not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, seeds[at]), len(self.hashes) - 1)
        ok = self.hashes[k] == seeds[at]
        return at[ok], k[ok]


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local score, end of it in ``passage``) of two word sequences, with a linear gap cost."""
    cols = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], diagonal)
        row = np.maximum.accumulate(new + cols) - cols  # a gap along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


@dataclass
class Items:
    """A block of benchmark items: ids, words, and the seeds of each that has LEAST_WORDS words."""

    ids: pa.Array
    words: list[np.ndarray]

    def seeds(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, item, place) of every seed of ``size`` words of every item."""
        each = [seed_hashes(w, size) if len(w) >= LEAST_WORDS else np.zeros(0, U) for w in self.words]
        item = np.repeat(np.arange(len(each)), [len(x) for x in each])
        place = np.concatenate([np.arange(len(x)) for x in each]) if each else np.zeros(0, np.int64)
        return (np.concatenate(each) if each else np.zeros(0, U)), item, place

    def distinct_seeds(self) -> np.ndarray:
        return np.unique(np.concatenate([self.seeds(k)[0] for k in range(1, SEED_WORDS + 1)]))

    def short(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Words of an item -> (sorted hashes, items) of the items of so few words."""
        out = {}
        for size in range(1, LEAST_WORDS):
            own = [i for i, w in enumerate(self.words) if len(w) == size]
            if own:
                hashes = np.array([seed_hashes(self.words[i], size)[0] for i in own], U)
                order = np.argsort(hashes, kind="stable")
                out[size] = hashes[order], np.array(own)[order]
        return out


def _items(rows: pa.Table) -> Items:
    """Items of a table (id, text) of clean texts."""
    words = []
    for _, data, offsets in blocks(rows.column(1).cast(pa.string())):
        hashes, first = word_hashes(data, offsets)
        words += [hashes[a:b] for a, b in zip(first, first[1:])]
    return Items(rows.column(0).combine_chunks(), words)


def _spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many[k]`` places from ``begin[k]`` on, one behind the other."""
    return np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _hits(words: np.ndarray, first: np.ndarray, known: SeedSet, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, seed, row) where a row holds a known seed of ``size`` words."""
    at, which = known.find(seed_hashes(words, size))
    row = np.searchsorted(first, at, "right") - 1
    inside = at + size <= first[row + 1]
    return at[inside], which[inside], row[inside]


def _as_they_stand(words: np.ndarray, first: np.ndarray, short: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(row, item) of short items that a row holds word by word, or is, where an item is shorter than a seed."""
    out = []
    for size, (hashes, items) in short.items():
        at, which, row = _hits(words, first, SeedSet(np.unique(hashes)), size)
        if size < SEED_WORDS:
            whole = first[row + 1] - first[row] == size
            which, row = which[whole], row[whole]
        for r, k in np.unique(np.stack((row, which), 1), axis=0).tolist():
            value = np.unique(hashes)[k]
            a, b = np.searchsorted(hashes, [value, value + U(1)]) if value != ~U(0) else (np.searchsorted(hashes, value), len(hashes))
            out += [(r, int(i)) for i in items[a:b]]
    return out


class Search:
    """Looks for a block's items in blocks of texts; made once a task."""

    def __init__(self, items: Items, common: np.ndarray, leak: float):
        self.items, self.leak, self.short = items, leak, items.short()
        self.band = np.array([max(2, len(w) // 4) for w in items.words], np.int64)
        #: So many common two-word seeds at about the same distance as there are in any item with one word in three replaced.
        self.need = np.array([max(2, len(w) // 4 - 1) for w in items.words], np.int64)
        self.sets = []
        for size in range(1, SEED_WORDS + 1):
            seed, item, place = items.seeds(size)
            order = np.argsort(seed, kind="stable")
            distinct, begin = np.unique(seed[order], return_index=True)
            self.sets.append((size, SeedSet(distinct), item[order], place[order], np.append(begin, len(seed)), ~np.isin(distinct, common)))

    def _candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of seeds that call for an alignment, sorted."""
        rows, which_item, far, good = [], [], [], []
        for size, known, item, place, begin, is_rare in self.sets:
            at, which, row = _hits(words, first, known, size)
            if size == 1:  # a common word tells nothing
                rare = is_rare[which]
                at, which, row = at[rare], which[rare], row[rare]
            many = begin[which + 1] - begin[which]
            pick = _spread(begin[which], many)
            r, i, d, ok = np.repeat(row, many), item[pick], np.repeat(at, many) - place[pick], np.repeat(is_rare[which], many)
            order = np.lexsort((d, i, r))
            r, i, d, ok = r[order], i[order], d[order], ok[order]
            if size > 1 and len(r):
                need = np.full(len(r), 2) if size == SEED_WORDS else self.need[i]
                pair = np.cumsum(np.concatenate(([0], (np.diff(r) != 0) | (np.diff(i) != 0))))
                low = int(d.min())
                key = pair * (int(d.max()) - low + int(self.band.max()) + 2) + (d - low)
                near = np.searchsorted(key, key + self.band[i], "right") - np.arange(len(key))  # seeds from here to the band's end
                dense = np.flatnonzero(near >= need)
                cover = np.zeros(len(key) + 1, np.int64)
                np.add.at(cover, dense, 1)
                np.add.at(cover, dense + near[dense], -1)
                ok = ok | (np.cumsum(cover[:-1]) > 0)
            rows.append(r[ok])
            which_item.append(i[ok])
            far.append(d[ok])
        r, i, d = np.concatenate(rows), np.concatenate(which_item), np.concatenate(far)
        order = np.lexsort((d, i, r))
        return r[order], i[order], d[order]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, item, score) of what leaks."""
        words, first = word_hashes(data, offsets)
        out = [(r, i, 1.0) for r, i in _as_they_stand(words, first, self.short)]
        row, item, far = self._candidates(words, first)
        cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1
        for group in np.split(np.arange(len(far)), cut) if len(far) else []:
            r, i = int(row[group[0]]), int(item[group[0]])
            own = self.items.words[i]
            best = max(smith_waterman(own, words[max(first[r], a) : min(first[r + 1], b)])[0] for a, b in _stretches(far[group], len(own)))
            score = best / (MATCH * len(own))
            if score >= self.leak:
                out.append((r, i, score))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: list[Column], text: str = "text", item_id: str = "item_id", item_text: str = "text", leak: float = LEAK, block_words: int = BLOCK_WORDS, names: tuple[str, str] = ("item_id", "score")) -> DataFrame:
    """(keys, item_id, score) for each document and item that align at ``leak`` or more of a perfect score.

    The benchmark is searched in blocks of bounded size, each against all
    documents in two passes and without a shuffle of texts: one counts the
    documents that hold each seed of one to three words, the other aligns a
    document with an item where they share a rare seed, or common ones at about
    the same distance: two of three words, or about a quarter of the item's
    seeds of two. So a seed that many leaks have made common still finds them,
    as does a copy with one word in three replaced, while chance matches of
    common words are not aligned. Alignment is on the item's length and as much
    again on either side of a seed. score: alignment score over that of the
    whole item.

    Items of under LEAST_WORDS words leak where a document holds all their
    words in a row (score 1), and items of one or two words where a document
    has no others. Null and empty texts match nothing. Repeated documents each
    return their rows; repeated items return a row each. Ids may be of any type
    that Arrow knows. Case and punctuation are ignored. Empty tables give an
    empty result. ``names`` are those of the last two columns.
    """
    spark = docs.sparkSession
    clean = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    bench = benchmark.select(F.col(item_id).alias("id"), clean(item_text).alias("text")).withColumn("n", F.size(F.split("text", r"\s+")))
    total = bench.agg(F.sum("n")).first()[0] or 0
    n_blocks = int(total // block_words) + 1
    kind = benchmark.schema[item_id].dataType.simpleString()
    kept = docs.select(*keys)
    source = docs.select(*keys, clean(text).alias(*columns_like(kept, "text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    found = []
    for k in range(n_blocks):
        part = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k)
        items = _items(part.select("id", "text").orderBy("id", "text").toArrow())  # at most about block_words words
        seeds = spark.sparkContext.broadcast(items.distinct_seeds())

        def count(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            known = SeedSet(seeds.value)
            held, n_rows = np.zeros(len(seeds.value), np.int64), 0
            for batch in batches:
                n_rows += batch.num_rows
                for _, data, offsets in blocks(batch.column(0), STRETCH_BYTES):
                    words, first = word_hashes(data, offsets)
                    for size in range(1, SEED_WORDS + 1):
                        _, which, row = _hits(words, first, known, size)
                        pairs = np.unique(row * len(held) + which)
                        held += np.bincount(pairs % max(1, len(held)), minlength=len(held))
            some = np.flatnonzero(held)
            # the row without a seed counts the documents
            yield pa.RecordBatch.from_arrays([pa.array([None, *seeds.value[some].view(np.int64).tolist()], pa.int64()), pa.array([n_rows, *held[some].tolist()], pa.int64())], names=["seed", "n"])

        counts = durable(source.select(source.columns[-1]).mapInArrow(frugal(count), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), "seed-counts")
        n_docs = (counts.where("seed is null").first() or [None, 0])[1]
        # at most the block's seeds, of which few are common
        common = counts.where("seed is not null").where(F.col("n") > max(RARE_LEAST, n_docs * RARE_SHARE)).select("seed").toArrow().column(0).to_numpy().view(U)
        shared = spark.sparkContext.broadcast((items, common))

        def align(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, common = shared.value
            search = Search(items, common, leak)
            for batch in batches:
                out: list[tuple[int, int, float]] = []
                for base, data, offsets in blocks(batch.column(batch.num_columns - 1), STRETCH_BYTES):
                    out += [(base + r, i, score) for r, i, score in search(data, offsets)]
                at = pa.array([x[0] for x in out], pa.int64())
                ids = items.ids.take(pa.array([x[1] for x in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), ids, pa.array([x[2] for x in out], pa.float64())], names=[*batch.schema.names[:-1], *names])

        found.append(source.mapInArrow(frugal(align), f"{schema}, `{names[0]}` {kind}, `{names[1]}` double"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _stretches(diagonals: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stretches of a document around seeds: ``n`` words beyond either end of where the item would lie, joined where they meet."""
    out: list[tuple[int, int]] = []
    for d in np.sort(diagonals).tolist():
        a, b = d - n, d + 2 * n
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay, whatever their names.

    The leaks are found by :func:`find_leaks` and taken out by an anti join on
    the id and a hash of the text, so a null id is no reason to go. Rows that
    repeat stay or go together.
    """
    mine = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    key, mark, item, score = columns_like(docs, "leak_id", "leak_hash", "item_id", "score")
    leaks = durable(find_leaks(docs, benchmark, [F.col(id_col).alias(key), mine.alias(mark)], names=(item, score)).select(key, mark).distinct(), "leaks")
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col(key)) & (mine == F.col(mark)), "left_anti")
