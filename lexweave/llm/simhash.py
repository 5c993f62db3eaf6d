"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytesets import LOWER, IS_SPACE, U, blocks, frugal, words, xxh64
from .components import connected_components
from .durable import durable

RADIUS = 2
SHINGLE_WORDS = 3
TILE = 2048
#: Pairs of the four 16-bit ranges of a fingerprint. Bits that differ lie in at most RADIUS ranges, so two
#: fingerprints within the radius agree on one of these pairs: a key of 32 bits, which few others share.
BANDS = tuple((a, b) for a in range(4) for b in range(a + 1, 4))
_LANES = U(0x0001000100010001)


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of ``count`` hashes, which lie one behind the other in ``h``: bit set if it is set in over half of them."""
    begin = np.concatenate(([0], np.cumsum(count)))
    counts = np.zeros((len(count), 64), np.int64)
    some = np.flatnonzero(count)
    if some.size:
        # 16-bit counters side by side in one word: at most 65,535 hashes to a sum
        parts = np.concatenate([np.arange(begin[i], begin[i + 1], 65_535) for i in some]) if count.max() > 65_535 else begin[some]
        owner = np.searchsorted(begin, parts, "right") - 1
        sums = np.zeros((len(parts), 64), np.int64)
        for k in range(16):
            packed = np.add.reduceat((h >> U(k)) & _LANES, parts)
            for j in range(4):
                sums[:, k + 16 * j] = (packed >> U(16 * j)) & U(0xFFFF)
        np.add.at(counts, owner, sums) if len(parts) > len(some) else counts.__setitem__(owner, sums)
    bits = (2 * counts > count[:, None]).astype(U)
    return (bits << np.arange(64, dtype=U)).sum(axis=1, dtype=U)


def fingerprint_block(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each row: bit set if it is set in over half of the row's shingle hashes."""
    starts, ends, first = words(data, offsets)
    solid = ~IS_SPACE[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    place = np.concatenate(([0], np.cumsum(keep)))
    text = np.where(solid, LOWER[data], np.uint8(32))[keep]
    # a row that ends in a word has no space behind it, and none of its shingles needs one
    starts, ends = place[starts], place[ends - 1] + 1 if len(ends) else ends
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), shingles)
    begin = np.concatenate(([0], np.cumsum(shingles)))
    head = first[row] + (np.arange(begin[-1]) - begin[row])
    tail = np.minimum(head + n - 1, first[row + 1] - 1)
    h = xxh64(text, starts[head], ends[tail]) if len(head) else np.zeros(0, U)
    return majority(h, shingles)


def with_fingerprint(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, fp long) for every row of ``docs``; null texts count as empty, whose fingerprint is zero."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint_block(data, offsets) for _, data, offsets in blocks(batch.column(1))]
            fp = np.concatenate(out) if out else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), f"id {kind.simpleString()}, fp long")


def forest(values: np.ndarray, radius: int = RADIUS, tile: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links values at ``radius`` or fewer differing bits.

    Searches breadth first: a tile of reached values is compared by exclusive-or
    and bit counts with the values not yet reached, of which only the range of
    population counts within the radius is looked at.
    """
    order = np.argsort(pops := np.bitwise_count(values), kind="stable")
    values, pops = values[order], pops[order].astype(np.int64)
    free = np.arange(len(values))
    a, b = [], []
    queue: list[int] = []
    while free.size:
        if not queue:
            queue, free = [int(free[0])], free[1:]
        now, queue = np.array(queue[:tile]), queue[tile:]
        lo, hi = np.searchsorted(pops[free], [pops[now].min() - radius, pops[now].max() + radius + 1])
        if (near := free[lo:hi]).size:
            close = np.bitwise_count(values[now][:, None] ^ values[near][None, :]) <= radius
            hit = close.any(axis=0)
            if hit.any():
                found = near[hit]
                a.append(values[now][close[:, hit].argmax(axis=0)])
                b.append(values[found])
                queue += found.tolist()
                free = np.concatenate((free[:lo], near[~hit], free[hi:]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, U), np.zeros(0, U))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (tile, fp) sorted by tile; edges of a forest of each tile."""

    def run(tile: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.concatenate(([0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        left, right = [fp[two]], [fp[two + 1]]
        ok = np.bitwise_count(left[0] ^ right[0]) <= RADIUS
        left, right = [left[0][ok]], [right[0][ok]]
        for i in np.flatnonzero(size > 2):
            x, y = forest(fp[cut[i] : cut[i + 1]])
            left.append(x)
            right.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])

    rest_tile, rest_fp = np.zeros(0, np.int64), np.zeros(0, U)
    for batch in batches:
        tile = np.concatenate((rest_tile, batch.column(0).to_numpy()))
        fp = np.concatenate((rest_fp, batch.column(1).to_numpy().view(U)))
        if not len(tile):
            continue
        last = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on in the next batch
        if last:
            yield run(tile[:last], fp[:last])
        rest_tile, rest_fp = tile[last:], fp[last:]
    if len(rest_tile):
        yield run(rest_tile, rest_fp)


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b) pairs of the distinct fingerprints in column ``fp`` that join all within RADIUS bits.

    Tiles are cut by bit ranges: fingerprints within the radius agree on one of
    the pairs of ranges in ``BANDS``, so tiles of unlike values are never paired.
    A value shared by over ``tile`` fingerprints is cut again, by population
    count and a hash; each of its fingerprints goes to the pairs of tiles that
    lie within the radius. No link is lost, and no task gets more than two
    tiles of a group.
    """
    part = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), (part(x) * 65_536 + part(y)).alias("key")) for k, (x, y) in enumerate(BANDS)])).alias("x")
    cut = prints.select("fp", band).select("fp", "x.band", "x.key")
    # stored, so that the join has a plain shuffle on either side and a frequent value can be split
    sizes = durable(cut.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared-ranges")
    pop = F.bit_count("fp").cast("int")
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.struct(pop.alias("pop"), F.pmod(F.hash("fp"), parts).alias("part"))
    other = F.flatten(F.transform(F.sequence(F.lit(-RADIUS), F.lit(RADIUS)), lambda d: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct((F.col("own.pop") + d).alias("pop"), p.alias("part")))))
    pairs = F.when(F.col("parts") > 1, F.transform(other, lambda o: F.xxhash64("band", "key", F.least("own", o), F.greatest("own", o)))).otherwise(F.array(F.xxhash64("band", "key")))
    dealt = cut.join(sizes, ["band", "key"]).select("fp", "band", "key", parts.alias("parts"), own.alias("own")).select(F.explode(pairs).alias("tile"), "fp")
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(frugal(_links), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased A-Z, cut to words at ASCII white space and hashed as
    3-word shingles with XXH64 (seed 42). Fingerprints at 2 or fewer differing
    bits are linked; component_id is the least id that can be reached. Equal
    fingerprints are compared once, whatever their number. Null and empty texts
    have fingerprint zero, linked like any other. Repeated rows each return
    their row; rows with a null id are grouped too, and component_id is null
    only where all of a group's ids are. An empty table gives an empty result.
    """
    own = durable(with_fingerprint(docs, text, id_col), "fingerprints")
    prints = durable(own.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    roots = connected_components(links(prints.select("fp")), "a", "b")
    placed = durable(prints.join(roots, prints.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots")
    least = durable(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "least-ids")
    labels = durable(placed.join(least, "root").select("fp", "component_id"), "labels")
    return own.join(labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
