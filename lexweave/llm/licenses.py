"""Licence scans: TF-IDF cosine of headers and licence files to templates, inherited along directories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bytesets import blocks, frugal
from .decontaminate import _SOLID, SeedSet, word_hashes
from .durable import columns_like, durable

#: Phrases by licence (fixed values): the usual header lines and the first words of licence files.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "BSD-3-Clause": (
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
#: Least cosine of a line, or of neighbouring lines together, with a template.
LEAST_COSINE = 0.75
#: Names of licence files, whose licence covers their directory and all below it.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"


@dataclass(frozen=True)
class Templates:
    """Template vectors over the vocabulary of all templates."""

    licences: tuple[str, ...]
    vocabulary: np.ndarray  # sorted word hashes
    counts: np.ndarray  # templates x vocabulary

    def vectors(self, idf: np.ndarray) -> np.ndarray:
        v = self.counts * idf
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def build_templates(texts: dict[str, tuple[str, ...]] = TEMPLATES) -> Templates:
    names, rows = zip(*[(k, t.lower()) for k, ts in texts.items() for t in ts])
    words = []
    for _, data, offsets in blocks(pa.array(rows)):
        hashes, first = word_hashes(data, offsets)
        words += [hashes[a:b] for a, b in zip(first, first[1:])]
    vocabulary = np.unique(np.concatenate(words))
    counts = np.zeros((len(words), len(vocabulary)))
    for i, w in enumerate(words):
        np.add.at(counts[i], np.searchsorted(vocabulary, w), 1)
    return Templates(names, vocabulary, counts)


def idf_of(held: np.ndarray, n_docs: int) -> np.ndarray:
    """Smoothed inverse document frequencies."""
    return np.log((n_docs + 1) / (held + 1)) + 1


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of lines, first line of each row and the total)."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[offsets[:-1]] = True
    starts = np.flatnonzero(cut[: len(data)])
    return starts, np.searchsorted(starts, offsets)


def scan_block(data: np.ndarray, offsets: np.ndarray, known: SeedSet, vectors: np.ndarray, idf: np.ndarray, rare: float, least: float) -> list[tuple[int, int, float, int]]:
    """(row, template, cosine, line) of the best line or run of lines of each row that reaches ``least``.

    A line is looked at if template words carry enough of its weight for the
    cosine to reach ``least`` at all, so nothing is missed by that. Words that
    no template has weigh ``rare`` each.
    """
    words, _ = word_hashes(data, offsets)
    if not len(words):
        return []
    starts, first = _lines(data, offsets)
    at, which = known.find(words)
    begin = _word_starts(data, offsets)
    line = np.searchsorted(starts, begin, "right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    hit_line = line[at]
    # count each word of a line once with its square weight, repeated words by their square count
    key = hit_line * len(idf) + which
    pair, times = np.unique(key, return_counts=True)
    pl, pw = pair // len(idf), pair % len(idf)
    weight = np.bincount(pl, (times * idf[pw]) ** 2, minlength=len(starts))
    foreign = (n_words - np.bincount(hit_line, minlength=len(starts))) * rare**2
    good = weight > 0
    good &= weight >= least**2 * (weight + foreign) - 1e-9
    lines = np.flatnonzero(good)
    if not len(lines):
        return []
    row = np.searchsorted(first, lines, "right") - 1
    dense = np.zeros((len(lines), len(idf)))
    slot = np.full(len(starts), -1)
    slot[lines] = np.arange(len(lines))
    mine = slot[pl] >= 0
    dense[slot[pl[mine]], pw[mine]] = times[mine] * idf[pw[mine]]
    # neighbouring candidate lines of a row, together
    chain = np.concatenate(([0], np.cumsum((np.diff(lines) > 1) | (np.diff(row) > 0))))
    heads = np.flatnonzero(np.concatenate(([True], np.diff(chain) > 0)))
    joined = np.add.reduceat(dense, heads, axis=0)
    alien = np.add.reduceat(foreign[lines], heads)
    both, outside = np.concatenate((dense, joined)), np.concatenate((foreign[lines], alien))
    where = np.concatenate((lines, lines[heads]))
    cosine = both @ vectors.T / np.sqrt((both**2).sum(axis=1) + outside)[:, None]
    best = cosine.argmax(axis=1)
    score = cosine[np.arange(len(best)), best]
    rows = np.searchsorted(first, where, "right") - 1
    out: dict[int, tuple[float, int, int]] = {}
    for r, t, s, w in zip(rows.tolist(), best.tolist(), score.tolist(), (where - first[rows]).tolist()):
        if s >= least and (r not in out or (s, -w) > (out[r][0], -out[r][2])):
            out[r] = (s, t, w)
    return [(r, t, s, w) for r, (s, t, w) in out.items()]


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    solid = np.zeros(len(data) + 1, bool)
    solid[1:] = _SOLID[data]
    starts = solid[1:] & ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] = solid[inner + 1]
    return np.flatnonzero(starts)


def detect(files: DataFrame, keys: list[Column], text: str = "text", least: float = LEAST_COSINE, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(keys, licence, score, line) of every file; licence is null where no line is like a template.

    One pass counts in how many files each template word stands, the next
    compares every line of every file. What is broadcast is the templates.
    """
    spark = files.sparkSession
    templates = build_templates(texts)
    kept = files.select(*keys)
    clean = F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias(*columns_like(kept, "text"))
    source = files.select(*keys, clean)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = SeedSet(templates.vocabulary)
        held, n = np.zeros(len(templates.vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, data, offsets in blocks(batch.column(0)):
                words, first = word_hashes(data, offsets)
                at, which = known.find(words)
                row = np.searchsorted(first, at, "right") - 1
                held += np.bincount(np.unique(row * len(held) + which) % len(held), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(held))]), pa.array([n, *held.tolist()])], names=["word", "n"])

    totals = {r["word"]: r["n"] for r in source.select(source.columns[-1]).mapInArrow(frugal(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the templates' words
    n_docs = totals.get(-1, 0)
    idf = idf_of(np.array([totals.get(k, 0) for k in range(len(templates.vocabulary))], float), n_docs)
    shared = spark.sparkContext.broadcast((templates, templates.vectors(idf), idf, float(idf_of(np.zeros(1), n_docs)[0])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, vectors, idf, rare = shared.value
        known = SeedSet(templates.vocabulary)
        for batch in batches:
            licence: list[str | None] = [None] * batch.num_rows
            score, line = [0.0] * batch.num_rows, [-1] * batch.num_rows
            for base, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                for r, t, s, w in scan_block(data, offsets, known, vectors, idf, rare, least):
                    licence[base + r], score[base + r], line[base + r] = templates.licences[t], round(s, 6), w
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(licence, pa.string()), pa.array(score, pa.float64()), pa.array(line, pa.int64())], names=[*batch.schema.names[:-1], "licence", "score", "line"])

    return source.mapInArrow(frugal(scan), f"{schema}, licence string, score double, line long")


def directory(path: Column) -> Column:
    """All before the last slash; empty for a file at the root."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def ancestors(path: Column) -> Column:
    """The directory and all above it, nearest first, the root (empty) last."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def inherit(found: DataFrame, path: str = "path") -> DataFrame:
    """``found`` (stored, with licence and score) with origin and licence_path.

    A file's own licence is ``own``. Other files take that of the licence file
    in the nearest directory above them (``inherited``); of several there, the
    best score wins, then the least path. Directories are resolved once each,
    by joining their ancestors with directories that have a licence, and files
    then join their directory. What is joined is stored before, so that a
    directory of very many files, or one above very many, can be split.
    """
    here, up, file, given, far, near_ = columns_like(found, "dir", "up", "from", "given", "far", "near")
    place = F.coalesce(F.regexp_replace(F.col(path), "/+", "/"), F.lit(""))
    rows = found.withColumn(here, directory(F.regexp_replace(place, "^/", "")))
    own = rows.where(F.col(path).rlike(LICENCE_FILE) & F.col("licence").isNotNull())
    first = F.min(F.struct(-F.col("score"), F.col(path).alias("p"), F.col("licence").alias("l"))).alias("b")
    best = durable(own.groupBy(here).agg(first).select(F.col(here).alias(up), F.col("b.p").alias(file), F.col("b.l").alias(given)), "licensed-directories")
    dirs = durable(rows.where("licence is null").select(here).distinct(), "open-directories")
    climbs = dirs.select(here, F.posexplode(ancestors(F.col(here))).alias(far, up))
    near = durable(climbs.join(best, up).groupBy(here).agg(F.min(F.struct(far, file, given)).alias(near_)), "nearest-licences")
    joined = rows.join(near, here, "left")
    taken = F.col("licence").isNull() & F.col(near_).isNotNull()
    origin = F.when(F.col("licence").isNotNull(), "own").when(taken, "inherited").otherwise("none")
    source = F.when(F.col("licence").isNotNull(), F.col(path)).when(taken, F.col(near_)[file])
    return joined.withColumns({"origin": origin, "licence_path": source, "licence": F.when(taken, F.col(near_)[given]).otherwise(F.col("licence"))}).drop(here, near_)


def scan_licences(files: DataFrame, path: Column, keys: list[Column], text: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """One row per file: keys, path, licence, score, line, origin, licence_path.

    Whole texts are scanned, not only their heads. Null and empty texts have no
    licence of their own; a null path lies at the root. Equal paths and
    repeated rows each return their row. An empty table gives an empty result.
    """
    found = durable(detect(files, [*keys, path.alias("path")], text, least), "licences")
    return inherit(found)
