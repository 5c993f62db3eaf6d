"""Token ids in files of fixed-width bit fields.

A file is: magic and version, bits per id, ids per block, counts of documents,
ids and blocks (little-endian), then one byte offset per block and the end, one
int64 id per document (the least int64 for null), one start per document and
the end, and the blocks. A block holds BLOCK_IDS ids, least bits first, in
64-bit little-endian words; since BLOCK_IDS is a multiple of 64, any block is
unpacked on its own by a handful of numpy shifts. Files are the ``content``
column of a Parquet table, so that Spark's commit protocol keeps or drops them
as a whole on any store; :func:`unpack_file` reads the bytes wherever they lie.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytesets import frugal
from .tokens import encoder, size

MAGIC = b"LXWIDS01"
HEADER = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 4096
#: A file is closed when it holds so many ids.
FILE_IDS = 1 << 21
NULL_ID = np.iinfo(np.int64).min
#: Widths of the integers that numpy has.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words with ``bits`` bits per id; the last group of 64 ids is filled up with zeros. Ids that do not fit are an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in WHOLE:  # each id is an integer of its own
        out = np.zeros(-(-len(ids) // 64) * 64, WHOLE[bits])
        out[: len(ids)] = ids
        return out.view("<u8").astype(np.uint64, copy=False)
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= groups[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= groups[:, k] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed ``words``."""
    if bits in WHOLE:
        return words.astype("<u8", copy=False).view(WHOLE[bits])[:n].astype(np.uint32)
    words = words.reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = x & mask
    return out.reshape(-1)[:n]


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    blocks = -(-len(ids) // BLOCK_IDS)
    words = pack(ids, bits)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * np.uint64(BLOCK_IDS * bits // 8), np.uint64(8 * len(words)))
    head = HEADER.pack(MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids), blocks)
    names = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    return b"".join((head, offsets.tobytes(), names.tobytes(), starts.tobytes(), words.astype("<u8").tobytes()))


class TokenFile:
    """Reads a file's bytes; ids are unpacked only where asked for."""

    def __init__(self, content: bytes):
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids, n_blocks = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self._offsets = np.frombuffer(content, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(content, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(content, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self._words = np.frombuffer(content, "<u8", int(self._offsets[-1]) // 8 if n_blocks else 0, at)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop``, by unpacking the blocks that hold them."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        words = self._words[int(self._offsets[first]) // 8 : int(self._offsets[last + 1]) // 8]
        return unpack(words, self.bits, stop - first * self.block_ids)[start - first * self.block_ids :]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


_SCHEMA = "part int, seq int, first long, n_ids long, low_id long, high_id long, null_ids int, content binary"


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> None:
    """Write every document's ids and ``end_id``, in ascending id order, as token files below ``path``.

    An id takes the fewest bits that hold the tokenizer's vocabulary and
    ``end_id``. One range shuffle of the texts gives each task a run of ids
    (ties of the id go by a hash of the text, then by place, so that no number
    of equal rows gathers in one task), which it writes as files of about
    ``file_ids`` ids. Null texts count as empty, null ids come first. An empty
    table gives no file. Columns: part (rank of the run), seq (file within it),
    first (ids before it within the run), n_ids, low_id and high_id (the index
    by document: of one file in the table's statistics, so that a reader of one
    document skips the others), null_ids (documents without id), content.
    """
    bits = bits_for(max(size(vocabulary), end_id + 1))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("id"), F.xxhash64("text"), F.col("at")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, 0
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        held: list[bytes] = []
        n_ids = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, first, names, held, n_ids
            ids = np.frombuffer(b"".join(held), "<u4")
            content = pack_file(names, [len(x) // 4 for x in held], ids, bits)
            known = [x for x in names if x is not None] or [None]
            row = {"part": [part], "seq": [seq], "first": [first], "n_ids": [n_ids], "low_id": [known[0]], "high_id": [known[-1]], "null_ids": [names.count(None)], "content": [content]}
            kinds = {"part": pa.int32(), "seq": pa.int32(), "null_ids": pa.int32(), "content": pa.binary()}
            out = pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in row.items()})
            seq, first, names, held, n_ids = seq + 1, first + n_ids, [], [], 0
            return out

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                names.append(i.as_py())
                held.append(encode(t.as_py()) + end)
                n_ids += len(held[-1]) // 4
                if n_ids >= file_ids:
                    yield close()
        if held:
            yield close()

    rows = source.repartitionByRange(*order).sortWithinPartitions(*order).drop("at")
    rows.mapInArrow(frugal(run, keeps=True), _SCHEMA).write.parquet(path)


def lookup(spark: SparkSession, path: str, doc_id: int | None) -> DataFrame:
    """(ids array<int>) of the documents of one id; only files whose range holds it are read, and of those only the blocks with its ids."""
    hit = F.col("null_ids") > 0 if doc_id is None else F.lit(doc_id).between(F.col("low_id"), F.col("high_id"))
    files = spark.read.schema(_SCHEMA).parquet(path).where(hit).select("content")
    wanted = NULL_ID if doc_id is None else doc_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_py())
                found = [file.document(int(k)).view(np.int32) for k in np.flatnonzero(file.doc_ids == wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["ids"])

    return files.mapInArrow(frugal(run, keeps=True), "ids array<int>")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below ``path``."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    before, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row per task of the writer
        before[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, content in zip(*batch.columns):
                file = TokenFile(content.as_py())
                ids = file.ids().astype("<u4")
                raw = memoryview(ids.tobytes())
                cut = file.starts.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, pa.int64(), mask=file.doc_ids == NULL_ID),
                        pa.array(file.starts[:-1] + before[part.as_py()] + first.as_py()),
                        pa.array(np.diff(file.starts)),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                    ],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    return files.select("part", "first", "content").mapInArrow(frugal(run, keeps=True), f"{id_col} long, start long, n_tokens long, ids_crc32 long")
