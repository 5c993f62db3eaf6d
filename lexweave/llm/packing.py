"""Packing documents into training sequences by vector best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytesets import frugal
from .durable import durable
from .ranking import number_rows
from .tokens import encoder


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence: tokens, documents, and attention cost (the sum of squared lengths)."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: Weights of the three in scores.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    #: ``norm``: the bin with the least weighted norm of what is left; ``dot``: the greatest weighted dot product of item and room.
    rule: str = "norm"


def best_fit(counts: np.ndarray, limits: Limits) -> list[tuple[int, list[list[int]]]]:
    """Bins for ``counts[n]`` items of each length n: (number of equal bins, [[length, items], ...]).

    Longest items first; each goes to the open bin of the best score among
    those with room in every capacity, else to a new one. Bins of equal
    contents are one entry with a multiplicity, and an item is placed in all
    of them at once while items last. So time and memory depend on the number
    of distinct lengths, not of items: a length adds at most three entries.
    """
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights)
    room = np.zeros((64, 3))
    many = np.zeros(64, np.int64)
    inside: list[list[list[int]]] = []

    def add(left: np.ndarray, times: int, content: list[list[int]]) -> None:
        nonlocal room, many
        if len(inside) == len(many):
            room, many = np.concatenate((room, np.zeros_like(room))), np.concatenate((many, np.zeros_like(many)))
        room[len(inside)], many[len(inside)] = left, times
        inside.append(content)

    def grown(content: list[list[int]], length: int) -> list[list[int]]:
        out = [list(x) for x in content]
        if out and out[-1][0] == length:
            out[-1][1] += 1
        else:
            out.append([length, 1])
        return out

    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        need = np.array([length, 1, length * length], float)
        if left and (need > caps).any():
            raise ValueError(f"an item of {length} tokens exceeds the limits")
        while left:
            n = len(inside)
            fits = np.flatnonzero((room[:n] >= need).all(axis=1))
            if not fits.size:
                each = int((caps // need).min())
                if left // each:
                    add(caps - each * need, left // each, [[length, each]])
                if left % each:
                    add(caps - left % each * need, 1, [[length, left % each]])
                break
            if limits.rule == "dot":
                best = fits[np.argmax((weights * (need / caps) * (room[fits] / caps)).sum(axis=1))]
            else:
                best = fits[np.argmin((weights * ((room[fits] - need) / caps) ** 2).sum(axis=1))]
            take = min(left, int(many[best]))
            if take == many[best]:
                room[best] -= need
                inside[best] = grown(inside[best], length)
            else:
                many[best] -= take
                add(room[best] - need, take, grown(inside[best], length))
            left -= take
    return [(int(m), c) for m, c in zip(many, inside)]


def placement_table(bins: list[tuple[int, list[list[int]]]]) -> np.ndarray:
    """Rows (length, first rank, items per bin, first sequence, offset), sorted: where the k-th item of a length goes."""
    out, given, sequence = [], {}, 0
    for times, content in bins:
        offset = 0
        for length, items in content:
            out.append((length, given.get(length, 0), items, sequence, offset))
            given[length] = given.get(length, 0) + times * items
            offset += length * items
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut where longer than ``capacity``.

    The first piece is the shorter one, so that all others fill a sequence.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, t in enumerate(batch.column(1)):
                ids = encode(t.as_py() or "") + end
                n = len(ids) // 4
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
            at, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(frugal(run, keeps=True), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, limits: Limits) -> DataFrame:
    """``pieces`` (stored) with ``sequence_id`` and ``offset``.

    The driver holds only the number of pieces of each length. Each piece gets
    its rank among those of its length, and the plan says where a rank goes.
    """
    counts = np.zeros(limits.tokens + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most limits.tokens rows
        counts[r["length"]] = r["n"]
    table = placement_table(best_fit(counts, limits))
    keys = (table[:, 0] << 45) + table[:, 1]
    plan = pieces.sparkSession.sparkContext.broadcast((keys, table))
    names = [*pieces.columns, "rank_"]
    ranked = number_rows(pieces, "length", [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], F.xxhash64("doc_id", "start", "ids_crc32"), "rank_").select(names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = plan.value
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy().astype(np.int64) for c in ("length", "rank_"))
            row = table[np.searchsorted(keys, (length << 45) + rank, "right") - 1] if len(length) else table[:0]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * length)], names=[*names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(frugal(run, keeps=True), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, limits: Limits = Limits(), end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is encoded whole and ended by ``end_id``; null texts count
    as empty and give one piece of one id. Only documents longer than a
    sequence are cut. Pieces fill each sequence gapless from offset 0, under
    all three limits. Repeated rows and rows with null ids are packed like any
    other. An empty table gives an empty result.
    """
    pieces = durable(token_pieces(docs, vocabulary, limits.tokens, end_id, id_col, text), "pieces")
    placed = place(pieces, limits)
    return placed if id_col == "doc_id" else placed.withColumnRenamed("doc_id", id_col)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, ids array<int>, lengths array<int>): the sequences themselves. Ids must be unique and not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            ids = [np.append(np.frombuffer(encode(t.as_py() or ""), "<u4"), end_id)[s.as_py() : s.as_py() + n.as_py()].astype(np.int32) for t, s, n in zip(batch["text"], batch["start"], batch["length"])]
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], batch["offset"], batch["length"], pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "offset", "length", "ids"])

    joined = placed.join(docs.select(id_col, F.col(text).alias("text")), id_col).select("text", "start", "length", "sequence_id", "offset")
    parts = joined.mapInArrow(frugal(run, keeps=True), "sequence_id long, offset long, length long, ids array<int>")
    one = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return parts.groupBy("sequence_id").agg(one.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").cast("array<int>").alias("lengths"))
