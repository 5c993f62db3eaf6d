"""Line dedup: winnowing over line hashes, matches extended both ways, later repeated runs deleted."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytesets import IS_SPACE, LOWER, RangeHash, U, blocks, frugal, words
from .durable import columns_like, durable

#: Words that a fingerprinted run of lines has at least.
RUN_WORDS = 12
#: A run of so many words that two documents share is sure to give a common fingerprint.
SURE_WORDS = 28
#: Words of a repeated run from which on it is deleted.
LEAST_WORDS = 20
#: Documents whose matches are extended at a time.
EXTEND_ROWS = 128
#: A line also ends behind one of so many words, chosen by the word's hash.
CUT_WORDS = 6


def lines(data: np.ndarray, offsets: np.ndarray, further: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, words, first line of each row and the total).

    A line ends behind a line feed, or behind a space that follows ``.``,
    ``!`` or ``?``: texts without line feeds have lines too. It also ends at
    the places ``further``. A line without a word belongs to the one before
    it, or else to the one after it.
    """
    after = np.zeros(len(data) + 1, bool)
    after[1:] = data == 10
    after[2:] |= (data[1:] == 32) & ((data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63))
    after[offsets] = True
    if further is not None:
        after[further] = True
    cuts = np.flatnonzero(after[: len(data)])
    begin, _, _ = words(data, offsets)
    count = np.diff(np.append(np.searchsorted(begin, cuts), len(begin)))
    starts, count = cuts[count > 0], count[count > 0]
    first = np.searchsorted(starts, offsets)
    has = np.flatnonzero(np.diff(first))
    starts = starts.copy()
    starts[first[has]] = offsets[has]  # the first line takes what lies before it
    return starts, count, first


def fingerprints(data: np.ndarray, offsets: np.ndarray, run_words: int = RUN_WORDS, sure_words: int = SURE_WORDS) -> tuple[np.ndarray, ...]:
    """(starts, words, line hashes, first line of each row, places of fingerprints, lines of each, their hashes).

    From each line on, the least run of lines with ``run_words`` words has a
    hash. A window is all such runs inside the least run with ``sure_words``
    words; the least hash of every window is a fingerprint. Equal runs of
    ``sure_words`` words hold equal windows, and so give equal fingerprints
    wherever they stand. A row of fewer words is one window. Hashes ignore
    white space and the case of A-Z.

    Lines end behind every word whose hash is a multiple of ``CUT_WORDS`` as
    well. That hangs on the word alone, so a shared stretch has the same lines
    wherever it begins and ends, also in the midst of an endless line.
    """
    solid = ~IS_SPACE[data]
    place = np.concatenate(([0], np.cumsum(solid)))
    ranges = RangeHash(LOWER[data[solid]])
    word, word_end, _ = words(data, offsets)
    chosen = ranges(place[word], place[word_end]) % U(CUT_WORDS) == 0 if len(word) else np.zeros(0, bool)
    starts, count, first = lines(data, offsets, word_end[chosen])
    n = len(starts)
    ends = place[np.append(starts[1:], len(data))] if n else starts
    begins = place[starts]
    hashes = ranges(begins, ends)
    upto = np.cumsum(count)
    before = upto - count
    run_end = np.searchsorted(upto, before + run_words)  # the last line of the run, perhaps in a later row
    sure_end = np.searchsorted(upto, before + sure_words)
    row = np.searchsorted(first, np.arange(n), "right") - 1
    stop = first[row + 1]
    whole = run_end < stop
    run_hash = np.full(n, ~U(0))
    run_hash[whole] = ranges(begins[whole], ends[run_end[whole]])
    last = np.searchsorted(run_end, sure_end, "right") - 1  # the last run inside the window
    window = sure_end < stop
    lone = first[:-1][np.diff(first) > 0]
    lone = lone[~window[lone] & whole[lone]]  # rows of one window
    inside = np.searchsorted(run_end, stop[lone]) - 1
    lo, hi = np.concatenate((np.flatnonzero(window), lone)), np.concatenate((last[window], inside))
    if not len(lo):
        return starts, count, hashes, first, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    # the place of the least hash in each window, the rightmost of equals, by doubling
    width = hi - lo + 1
    level = np.arange(n)
    best = np.full(len(lo), -1)
    for k in range(int(width.max()).bit_length()):
        own = np.flatnonzero((width >> k) == 1)
        a, b = level[lo[own]], level[hi[own] - (1 << k) + 1]
        best[own] = np.where(run_hash[b] <= run_hash[a], b, a)
        if len(level) > 1 << k:
            x, y = level[: len(level) - (1 << k)], level[1 << k :]
            level = np.concatenate((np.where(run_hash[y] <= run_hash[x], y, x), level[len(level) - (1 << k) :]))
    at = np.unique(best)
    return starts, count, hashes, first, at, run_end[at] - at + 1, run_hash[at]


_LISTS = "sizes array<int>, words array<int>, hashes array<long>, at array<int>, lines array<int>, lo array<int>, hi array<int>, print array<long>"


def _scan(run_words: int, sure_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in blocks(batch.column(2)):
                n = len(offsets) - 1
                starts, count, hashes, first, at, size, prints = fingerprints(data, offsets, run_words, sure_words)
                cut = np.searchsorted(at, first)
                row = np.searchsorted(first, at, "right") - 1
                head = first[row]
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points
                sizes = np.diff(points[np.append(starts, len(data))])  # a row's last line may get too many, which nothing reads
                # a match is extended to the fingerprints before and behind it, and by sure_words words at
                # least: those may be fingerprints here alone, for what stands outside the shared stretch
                near = np.diff(row) == 0
                lo, hi = np.zeros(len(at), np.int64), first[row + 1] - head - 1 if len(at) else at
                lo[1:] = np.where(near, at[:-1] - head[1:], 0)
                hi[:-1] = np.where(near, at[1:] + size[1:] - 1 - head[:-1], hi[:-1])
                upto = np.cumsum(count)
                lo = np.minimum(lo, np.maximum(np.searchsorted(upto - count, (upto - count)[at] - sure_words), head) - head)
                hi = np.maximum(hi, np.minimum(np.searchsorted(upto, upto[at + size - 1] + sure_words), first[row + 1] - 1) - head)
                by_line = lambda x, t, first=first: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, t))
                by_print = lambda x, t, cut=cut: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, t))
                i32, i64 = pa.int32(), pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(base, n), batch.column(1).slice(base, n),
                        by_line(sizes, i32), by_line(count, i32), by_line(hashes.view(np.int64), i64),
                        by_print(at - head if len(at) else at, i32), by_print(size, i32), by_print(lo, i32), by_print(hi, i32), by_print(prints.view(np.int64), i64),
                    ],
                    names=["id", "th", "sizes", "words", "hashes", "at", "lines", "lo", "hi", "print"],
                )

    return run


def text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


_RUNS = "array<struct<first_line:int,n_lines:int,start:int,stop:int,n_words:int,source_id:{kind},source_line:int>>"


def _offsets(column: pa.ListArray) -> list[int]:
    """Where each row's values begin among all, and the end."""
    return [0, *accumulate(column.value_lengths().to_pylist())]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, list[int]]:
    """(all values, offsets) of a column of lists of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False), _offsets(column)


def _extend(kind: str, least_words: int):
    """Each row's matches to runs of lines to delete, of ``least_words`` words or more. A match: place, lines, source id, source place, source lines from, their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few rows at a time, as their lists are copied
        for batch in (whole.slice(at, EXTEND_ROWS) for whole in batches for at in range(0, whole.num_rows, EXTEND_ROWS)):
            out = []
            all_sizes, _ = _flat(batch.column(2))
            all_counts, _ = _flat(batch.column(3))
            all_hashes, cut = _flat(batch.column(4))
            fields = dict(zip((f.name for f in batch.schema.field(5).type.value_type), batch.column(5).flatten().flatten()))
            places, sizes_of, source_at, theirs_from = (fields[k].to_numpy().tolist() for k in ("at", "lines", "source_at", "theirs_from"))
            ids, shapes = fields["source_id"].to_pylist(), fields["same_shape"].to_pylist()
            all_theirs, theirs_cut = _flat(fields["theirs"])
            match_cut = _offsets(batch.column(5))
            for r in range(batch.num_rows):
                own = slice(cut[r], cut[r + 1])
                sizes, count, hashes = all_sizes[own], all_counts[own], all_hashes[own]
                n, starts = len(hashes), (np.cumsum(sizes) - sizes).tolist()
                by = np.full(n, -1)  # the match that each line belongs to
                for m in sorted(range(match_cut[r], match_cut[r + 1]), key=lambda m: (places[m], source_at[m])):
                    at, last = places[m], places[m] + sizes_of[m] - 1
                    theirs, shift = all_theirs[theirs_cut[m] : theirs_cut[m + 1]], source_at[m] - theirs_from[m] - at  # line t is theirs[t + shift]
                    if shapes[m] and not np.array_equal(hashes[at : last + 1], theirs[at + shift : last + 1 + shift]):
                        continue  # unlike runs with one hash
                    back = min(at, at + shift)
                    odd = np.flatnonzero(hashes[at - back : at] != theirs[at + shift - back : at + shift])
                    a, b = at - back + (int(odd[-1]) + 1 if odd.size else 0), last
                    if shapes[m]:
                        on = max(0, min(n - 1 - last, len(theirs) - 1 - last - shift))
                        odd = np.flatnonzero(hashes[last + 1 : last + 1 + on] != theirs[last + 1 + shift : last + 1 + shift + on])
                        b = last + (int(odd[0]) if odd.size else on)
                    free = by[a : b + 1]
                    free[free < 0] = m
                source = [None if m < 0 else (ids[m], source_at[m] + t - places[m]) for t, m in enumerate(by.tolist())]
                count = count.tolist()
                runs, t = [], 0
                while t < n:
                    if source[t] is None:
                        t += 1
                        continue
                    e = t
                    while e + 1 < n and source[e + 1] is not None:
                        e += 1
                    if sum(count[t : e + 1]) >= least_words:
                        runs.append({"first_line": t, "n_lines": e - t + 1, "start": starts[t], "stop": starts[e + 1] if e + 1 < n else None, "n_words": sum(count[t : e + 1]), "source_id": source[t][0], "source_line": source[t][1]})
                    t = e + 1
                out.append(runs)
            kinds = pa.struct([("first_line", pa.int32()), ("n_lines", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("n_words", pa.int32()), ("source_id", batch.schema.field(0).type), ("source_line", pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(kinds))], names=["id", "th", "runs"])

    return run


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, sure_words: int = SURE_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, th, runs) of each document with lines that an earlier place holds too.

    Places are ordered by id, then a hash of the text, then line. Every
    fingerprint is joined with its first place, and if the line before or
    behind it differs there, with the first place of the fingerprint and that
    line together: so a longer stretch is found even where an older document
    has its fingerprints alone. From there the match goes on line by line both
    ways, by 64 bits of each line's hash. A run is (first_line, n_lines, start,
    stop, n_words, source_id, source_line); start and stop count characters,
    and stop is null at the end of the text. Every deleted line stays in an
    earlier place. Rows of equal id and text are one document. Runs of fewer
    than ``least_words`` words are never touched.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_hash(text).alias("th"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scan = durable(source.mapInArrow(frugal(_scan(run_words, sure_words)), f"id {kind}, th long, {_LISTS}").where("size(print) > 0"), "lines")
    before, behind = F.get("hashes", F.col("at") - 1).alias("before"), F.get("hashes", F.col("at") + F.col("lines")).alias("behind")
    marks = scan.select("id", "th", "hashes", F.inline(F.arrays_zip("print", "at", "lines", "lo", "hi"))).select("id", "th", "print", "at", "lines", "lo", "hi", before, behind)
    # only the hashes are counted at first; places are compared of those that occur twice
    twice = durable(marks.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "repeated-prints")
    # tables are stored before a join, so that it has a shuffle on either side and adaptive execution can split a frequent fingerprint
    shared = durable(marks.join(twice, "print"), "repeated-marks")
    first = durable(shared.groupBy("print").agg(F.min(F.struct("id", "th", "at", "lines", "before", "behind")).alias("f")), "first-places")
    place = [F.col(f"f.{c}").alias(f"f_{c}") for c in ("id", "th", "at", "lines")]
    another = ~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th")) & (F.col("at") == F.col("f.at")))
    odd = [F.when(~F.col(c).eqNullSafe(F.col(f"f.{c}")), F.col(c)).alias(c) for c in ("before", "behind")]
    mark = ["id", "th", "at", "lines", "lo", "hi"]
    joined = durable(shared.join(first, "print").where(another).select("print", *mark, *place, *odd), "first-matches")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("line")), F.struct(F.lit(1).alias("side"), F.col("behind").alias("line")))).alias("x")
    beside = durable(joined.where("before is not null or behind is not null").select("print", *mark, sides).where("x.line is not null").select("print", "x.side", "x.line", *mark), "odd-marks")
    again = durable(beside.groupBy("print", "side", "line").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at", "lines")).alias("f")).where("n > 1").drop("n"), "first-places-beside")
    more = durable(beside.join(again, ["print", "side", "line"]).where(another).select(*mark, *place).distinct(), "further-matches")
    back, on = F.col("at") - F.col("lo"), F.col("hi") - F.col("at")
    match = [F.col("f_id").alias("source_id"), F.col("f_at").alias("source_at"), (F.col("lines") == F.col("f_lines")).alias("same_shape"), F.greatest(F.col("f_at") - back, F.lit(0)).alias("theirs_from"), (F.col("f_at") + on).alias("theirs_to")]
    pairs = joined.drop("print", "before", "behind").unionByName(more).select("id", "th", "at", "lines", *match, F.xxhash64("f_id").alias("key"), F.col("f_th").alias("key_th"))
    # documents are joined by hashes of id and text, neither null: one shuffle serves the distinct rows and the join
    known = scan.select(F.xxhash64("id").alias("key"), F.col("th").alias("key_th"), "sizes", "words", "hashes").dropDuplicates(["key", "key_th"])
    sources = durable(known.select("key", "key_th", "hashes").join(pairs.select("key", "key_th").distinct(), ["key", "key_th"]), "line-sources")
    theirs = F.slice("hashes", F.col("theirs_from") + 1, F.col("theirs_to") - F.col("theirs_from") + 1).alias("theirs")
    seen = pairs.join(sources, ["key", "key_th"]).select("id", "th", F.struct("at", "lines", "source_id", "source_at", "same_shape", "theirs_from", theirs).alias("m"))
    matches = seen.select(F.xxhash64("id").alias("key"), F.col("th").alias("key_th"), "id", "m").groupBy("key", "key_th").agg(F.first("id").alias("id"), F.collect_set("m").alias("matches"))
    full = matches.join(known, ["key", "key_th"]).select("id", F.col("key_th").alias("th"), "sizes", "words", "hashes", "matches")
    return full.mapInArrow(frugal(_extend(kind, least_words)), f"id {kind}, th long, runs {_RUNS.format(kind=kind)}")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per deleted run: id, first_line, n_lines, start, stop, n_words, source_id, source_line.

    Documents without repeated runs have no row. Null and empty texts have no
    lines. An empty table gives an empty result.
    """
    return repeated_runs(docs, id_col, text).select(F.col("id").alias(id_col), F.inline("runs"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``; documents of which nothing is left go.

    Documents that had no text before are kept as they are. Rows of equal id
    and text are cut alike. All columns stay, whatever their names; an empty
    table gives an empty result.
    """
    key, mark, cuts, rest = columns_like(docs, "id", "th", "runs", "kept")
    runs = durable(repeated_runs(docs, id_col, text).select(F.col("id").alias(key), F.col("th").alias(mark), F.col("runs").alias(cuts)), "repeated-runs")
    joined = docs.join(runs, F.col(id_col).eqNullSafe(F.col(key)) & (text_hash(text) == F.col(mark)), "left").drop(key, mark)
    body = F.col(text)
    # what lies between the runs: from the end of one (or 0) to the start of the next (or the end of the text)
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda r: r["stop"]))
    stops = F.concat(F.transform(cuts, lambda r: r["start"]), F.array(F.length(body)))
    kept = F.array_join(F.transform(F.arrays_zip(begins.alias("b"), stops.alias("e")), lambda x: F.when(x["b"].isNull(), F.lit("")).otherwise(F.substring(body, x["b"] + 1, x["e"] - x["b"]))), "")
    new = joined.withColumn(rest, F.when(F.col(cuts).isNotNull(), kept))
    left = new.where(F.col(cuts).isNull() | F.col(rest).rlike(r"\S"))
    return left.withColumn(text, F.coalesce(rest, text)).drop(cuts, rest).select(docs.columns)
