"""Shards of near-equal size by longest-processing-time scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytesets import frugal
from .durable import columns_like, durable
from .ranking import number_rows


def longest_first(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, groups, shard) of a schedule of ``histogram``, which has (size, number of groups).

    Groups go by falling size, each to the least-loaded shard (ties to the
    lowest), through a heap. A shard gets at once all the equal groups that it
    would get in a row, and when loads differ by less than a group, every shard
    gets the same number of groups: a size costs a few steps, however many
    groups have it, and the loads are those of one group at a time.
    """
    heap = [(0, k) for k in range(shards)]
    out = []
    for size, left in sorted(histogram, reverse=True):
        given = [0] * shards
        while left:
            if left >= shards and max(heap)[0] - heap[0][0] < size:
                rounds = left // shards
                heap = [(load + rounds * size, k) for load, k in heap]
                given = [n + rounds for n in given]
                left -= rounds * shards
                continue
            load, k = heapq.heappop(heap)
            until, rival = heap[0] if heap else (load, k)
            run = min(left, max(1, -(-(until - load) // size) + ((until - load) % size == 0 and k < rival)))
            given[k] += run
            left -= run
            heapq.heappush(heap, (load + run * size, k))
        rank = 0
        for k, n in enumerate(given):
            if n:
                out.append((size, rank, n, k))
                rank += n
    return out


def assign_shards(rows: DataFrame, group: str, size: str, shards: int = 8) -> DataFrame:
    """``rows`` with a column ``shard``; rows of one ``group`` share it.

    The schedule needs only how many groups have each size, so the driver holds
    one entry for each distinct size: no more than the square root of twice the
    total size, however many groups there are. Each group finds its shard by
    its rank among those of its size. Null groups are one group; sizes are
    whole numbers from 1 on.
    """
    key, total, place = columns_like(rows, "group", "bytes", "rank")
    named = rows.withColumn(key, F.struct(group))
    groups = durable(named.groupBy(key).agg(F.sum(size).cast("long").alias(total)), "shard-groups")
    sizes = groups.groupBy(total).agg(F.count("*").alias("n")).toPandas()
    plan = np.array(sorted(longest_first(list(zip(sizes[total].tolist(), sizes["n"].tolist())), shards)), np.int64).reshape(-1, 4)
    shared = rows.sparkSession.sparkContext.broadcast(plan)
    kind = groups.schema[key].dataType.simpleString()
    ranked = number_rows(groups, total, [F.xxhash64(key), F.col(key)], F.xxhash64(key), place).select(key, total, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        ends = np.zeros(0, np.int64) if not len(table) else table[:, 1]
        for batch in batches:
            own, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            at = np.searchsorted(table[:, 0], own, "left") if len(table) else own
            # a size has at most one entry a shard, so its entry is found by steps
            for _ in range(shards - 1):
                on = np.minimum(at + 1, len(table) - 1)
                at = np.where((table[on, 0] == own) & (ends[on] <= rank) & (on > at), on, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table[at, 3].astype(np.int32))], names=[key, "shard"])

    where = durable(ranked.mapInArrow(frugal(run), f"{key} {kind}, shard int"), "shard-of-group")
    return named.join(where, key).drop(key)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1 (null: 1, like the empty text). Equal
    texts stay in one shard. The law is ``bytes``: shard sizes are near equal,
    as far as groups of equal texts allow. slot: place in the shard, gapless
    from 0. grown_shard is null, as this law does not fix it. Repeated rows are
    a group like any other equal texts and each get a slot. Rows with null ids
    are kept. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.md5(body.cast("binary")).alias("key"),
    )
    base = durable(base, "shard-rows")
    placed = durable(assign_shards(base, "key", "size", shards), "shard-placed")
    slots = number_rows(placed, "shard", [F.col(id_col), F.col("text_crc32"), F.col("key")], F.xxhash64(id_col, "text_crc32"), "slot")
    return slots.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
