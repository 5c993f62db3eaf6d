"""Near duplicates by SimHash of their sets of word shingles, confirmed by exact Jaccard similarity; an exact way for pairs whose fingerprints lie further apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .bytesets import LOWER, RangeHash, U, blocks, frugal, mix, words
from .components import connected_components
from .durable import durable

SHINGLE_WORDS = 5
#: Numerator and denominator of the similarity from which on two documents are linked.
LEAST = (4, 5)
#: Fewest and most bits of a set's parity map, which has a bit for each shingle between them. Folded to the narrower
#: one's width, two sets' maps differ in no more bits than the sets have unlike shingles.
PARITY_BITS = 512, 4096
TILE = 2048
#: Rows of a tile that are compared with all others at a time.
STRIP = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each row in ascending order, first of each row and the total).

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A
    row of fewer than ``n`` words has one shingle of all of them, a row without
    words has none.
    """
    starts, ends, first = words(data, offsets)
    each = RangeHash(LOWER[data])(starts, ends)
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), shingles)
    begin = np.cumsum(shingles) - shingles
    head = first[row] + np.arange(len(row)) - begin[row]
    hashes = np.zeros(len(row), U)
    for k in range(n):
        inside = np.flatnonzero(head + k < first[row + 1])
        hashes[inside] = mix(hashes[inside] + each[head[inside] + k])
    values = hashes.view(np.int64)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (values[1:] != values[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(count) + 1))


def set_hashes(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its members."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(values.view(U)), dtype=U)))
    return mix(sums[cut[1:]] - sums[cut[:-1]] + np.diff(cut).astype(U)).view(np.int64)


def parity_maps(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Each set's parity map: for each place, whether an odd number of its shingles fall there."""
    size = np.diff(cut)
    low, high = PARITY_BITS
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), low, high)
    out: list[bytes] = [b""] * len(size)
    for width in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == width)
        place = np.repeat(np.arange(len(rows)), size[rows])
        own = np.repeat(cut[rows] - np.concatenate(([0], np.cumsum(size[rows])[:-1])), size[rows]) + np.arange(len(place))
        odd = np.bincount(place * width + (values[own] & (width - 1)), minlength=len(rows) * width).astype(np.uint8) & 1
        packed = np.packbits(odd, bitorder="little").tobytes()
        for k, row in enumerate(rows.tolist()):
            out[row] = packed[k * width // 8 : (k + 1) * width // 8]
    return out


def _scan(n: int, least: tuple[int, int]):
    """Each row's set: its hash, fingerprint, size, parity map and prefix.

    Two sets that are similar enough share one of the least
    ``size - ceil(least * size) + 1`` hashes of each: that is the prefix.
    """
    num, den = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in blocks(batch.column(1)):
                values, cut = shingle_sets(data, offsets, n)
                rows, size = len(offsets) - 1, np.diff(cut)
                row = np.repeat(np.arange(rows), size)
                head = np.where(size > 0, size - -(-size * num // den) + 1, 0)
                kept = values[np.arange(len(values)) - cut[row] < head[row]]
                at = pa.array(np.concatenate(([0], np.cumsum(head))), pa.int32())
                maps = pa.array(parity_maps(values, cut), pa.binary())
                fp = pa.array(simhash.majority(values.view(U), size).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, rows), pa.array(set_hashes(values, cut)), fp, pa.array(size, pa.int32()), maps, pa.ListArray.from_arrays(at, pa.array(kept))], names=["id", "sig", "fp", "n", "parity", "prefix"])

    return run


def _whole(n: int):
    """Each row's set itself, with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                values, cut = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(values, cut)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values))], names=["sig", "shingles"])

    return run


def may_be_similar(maps: list[bytes], size: np.ndarray, root: np.ndarray, least: tuple[int, int] = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of sets of unlike ``root`` that size and parity do not keep from being similar enough.

    Maps are compared by exclusive-or and bit counts, at the narrower one's
    width; sets whose widths differ by more than one doubling are too unlike in
    size. A set of the most frequent root is compared with sets of other roots
    only.
    """
    num, den = least
    _, which, count = np.unique(root, return_inverse=True, return_counts=True)
    other = which != count.argmax()
    width = np.array([len(m) for m in maps]) // 8
    for w in np.unique(width).tolist():
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        wide = width[rows] > w
        narrow = np.zeros((len(rows), w), U)
        for part, doubled in ((np.flatnonzero(~wide), False), (np.flatnonzero(wide), True)):
            if part.size:
                raw = np.frombuffer(b"".join([maps[k] for k in rows[part].tolist()]), U).reshape(len(part), -1)
                narrow[part] = raw[:, :w] ^ raw[:, w:] if doubled else raw
        own = np.flatnonzero(other[rows])
        for at in range(0, len(own), STRIP):
            i = own[at : at + STRIP]
            far = np.zeros((len(i), len(rows)), np.int64)
            for k in range(w):
                far += np.bitwise_count(narrow[i, k][:, None] ^ narrow[:, k][None, :])
            a, b = size[rows[i]][:, None], size[rows][None, :]
            # the share of unlike shingles among a + b is (1 - j) / (1 + j) at similarity j
            ok = (far * (den + num) <= (a + b) * (den - num)) & (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (root[rows[i]][:, None] != root[rows][None, :])
            x, y = np.nonzero(ok & ~(wide[i][:, None] & wide[None, :]))
            yield rows[i][x], rows[y]


def _pairs(least: tuple[int, int]):
    """Batches of (tile, token, sig, n, root, parity) sorted by tile; the pairs of each tile to compare, with its token."""

    def tiles(table: pa.Table) -> pa.RecordBatch:
        tile, token, sig, size, root = (table.column(k).to_numpy() for k in range(5))
        maps = table.column(5).to_pylist()
        cut = np.concatenate(([0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]))
        none = np.zeros(0, np.int64)
        left, right, by = [none], [none], [none]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            for i, j in may_be_similar(maps[a:b], size[a:b].astype(np.int64), root[a:b], least):
                left.append(sig[a:b][i])
                right.append(sig[a:b][j])
                by.append(np.full(len(i), token[a]))
        x, y = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.concatenate(by))], names=["a", "b", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            last = int(np.searchsorted(tile := table.column(0).to_numpy(), tile[-1]))  # the last tile may go on in the next batch
            if last:
                yield tiles(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield tiles(rest)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS, least: tuple[int, int] = LEAST, tile: int = TILE) -> DataFrame:
    """One row per document: id, component_id.

    Documents whose sets of ``n``-word shingles have a Jaccard similarity of
    ``least`` or more are linked; component_id is the least id that can be
    reached. Ids must not be null. Candidates are sets whose SimHash
    fingerprints differ in at most ``simhash.RADIUS`` bits, by the tiled
    comparison of :mod:`simhash`. Similar sets may differ in more bits, so that
    there is an exact way for the rest, which misses no similar pair: each
    shares a shingle of both prefixes. Holders of a shared shingle are first
    paired with the least and the greatest of them; then all that these links
    and those by fingerprint have not joined, where size and parity map allow
    similarity, in pairs of tiles. Every link is confirmed on the whole sets.
    Documents with equal sets are compared once, whatever their number; texts
    without words are equal.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    own = durable(source.mapInArrow(frugal(_scan(n, least)), f"id {kind}, sig long, fp long, n int, parity binary, prefix array<long>"), "shingle-prefixes")
    close = fingerprint_pairs(own.select("fp", "sig"))
    marks = own.select("sig", F.explode("prefix").alias("token"))
    # tables are stored before a join, so that adaptive execution can split a frequent shingle
    ends = durable(marks.groupBy("token").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low < high"), "shared-shingles")
    holders = durable(marks.join(ends, "token").select("token", "low", "high", "sig").distinct(), "shingle-holders")
    pivots = holders.select("token", "sig", F.explode(F.array("low", "high")).alias("other")).where("sig != other")
    pivots = pivots.select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b"), "token")
    first = _confirmed(own, source, close.select("a", "b", F.lit(None).cast("long").alias("token")).unionByName(pivots), n, least)
    joined = durable(connected_components(first, "a", "b"), "first-roots")

    rooted = durable(holders.join(joined, F.col("sig") == F.col("node"), "left").select("token", "sig", F.coalesce("root", "sig").alias("root")), "rooted-holders")
    held = rooted.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("roots"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1")
    cut = lambda x: F.ceil(x / F.lit(tile)).cast("int")
    still = durable(held.select("token", F.col("top.root").alias("main"), cut(F.col("top.n")).alias("main_parts"), cut(F.col("all") - F.col("top.n")).alias("parts")), "open-shingles")
    is_main = F.col("root") == F.col("main")
    part = F.pmod(F.hash("sig"), F.when(is_main, F.col("main_parts")).otherwise(F.col("parts")))
    open_ = durable(rooted.join(still, "token").select("token", "sig", "root", is_main.alias("is_main"), "main_parts", "parts", part.alias("part")), "open-holders")
    # sets of a shingle's most frequent root meet all others, but not each other
    every = lambda parts, f: F.transform(F.sequence(F.lit(0), F.col(parts) - 1), f)
    spot = lambda main, p, q: F.xxhash64("token", F.lit(main), p, q)
    mine = F.col("part")
    among = every("parts", lambda q: spot(0, F.least(mine, q), F.greatest(mine, q)))
    spots = F.when(F.col("is_main"), every("parts", lambda p: spot(1, p, mine))).otherwise(F.concat(among, every("main_parts", lambda q: spot(1, mine, q))))
    maps = durable(own.groupBy("sig").agg(F.min("n").alias("n"), F.min("parity").alias("parity")), "parity-maps")
    tiled = open_.join(maps, "sig").select(F.explode(spots).alias("tile"), "token", "sig", "n", "root", "parity")
    rest = tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(frugal(_pairs(least)), "a long, b long, token long")
    links = first.unionByName(_confirmed(own, source, rest, n, least))

    roots = connected_components(links, "a", "b")
    reps = durable(own.groupBy("sig").agg(F.min("id").alias("rep")).join(roots, F.col("sig") == F.col("node"), "left").select("sig", "rep", F.coalesce("root", "sig").alias("root")), "set-roots")
    least_id = durable(reps.groupBy("root").agg(F.min("rep").alias("component_id")), "least-ids")
    labels = durable(reps.join(least_id, "root").select("sig", "component_id"), "set-labels")
    return own.select("id", "sig").join(labels, "sig").select(F.col("id").alias(id_col), "component_id")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of set hashes ``sig`` that join all whose fingerprints ``fp`` lie within ``simhash.RADIUS`` bits.

    Sets of one fingerprint are paired with the least of them, which also
    stands for it where two fingerprints are linked.
    """
    sets = durable(sets.distinct(), "set-fingerprints")
    prints = durable(sets.groupBy("fp").agg(F.min("sig").alias("rep")), "distinct-fingerprints")
    same = sets.join(prints, "fp").where("sig != rep").select("rep", "sig")
    links = durable(simhash.links(prints.select("fp")).distinct(), "near-fingerprints")
    a, b = (prints.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
    pairs = same.toDF("x", "y").unionByName(links.join(a, "a").join(b, "b").select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y")))
    return durable(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "fingerprint-pairs")


def _confirmed(own: DataFrame, source: DataFrame, pairs: DataFrame, n: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of set hashes whose sets are similar enough; each set is made anew from one of its texts.

    ``pairs`` has a row for each shared shingle of the prefixes. The sets have
    no more in common than those and what lies behind one of the prefixes, so
    pairs that this keeps from being similar enough are not compared. A row
    without a shingle is a pair that fingerprints have found, which is compared
    whatever it shares.
    """
    num, den = least
    size = own.groupBy("sig").agg(F.min("n").alias("n"))
    sized = pairs.distinct().groupBy("a", "b").agg(F.count("token").alias("shared"), F.max(F.col("token").isNull()).alias("close")).join(size.select(F.col("sig").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("sig").alias("b"), F.col("n").alias("n_b")), "b")
    behind = F.ceil(F.greatest("n_a", "n_b") * num / den) - 1
    enough = F.col("close") | ((F.col("shared") + behind) * (num + den) >= (F.col("n_a") + F.col("n_b")) * num)
    asked = durable(sized.where(enough & (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)).select("a", "b", "n_a", "n_b"), "asked-pairs")
    wanted = durable(asked.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "asked-sets")
    one = own.select("id", "sig").join(wanted, "sig").groupBy("sig").agg(F.min("id").alias("id")).select("id").distinct()
    # rows that share an id may have other sets, which go again
    whole = source.join(one, "id", "left_semi").select("text").mapInArrow(frugal(_whole(n)), "sig long, shingles array<long>").join(wanted, "sig", "left_semi").dropDuplicates(["sig"])
    whole = durable(whole, "whole-sets")
    x, y = (whole.select(F.col("sig").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return durable(asked.join(x, "a").join(y, "b").where(common * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b"), "similar-pairs")
