"""Extractive briefs: the sentences of retrieved passages that answer a question best."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze, strip
from .search import DOCUMENT_WEIGHTS, PAGE_SIZE, Index, focus_query, match, query_prefixes, retrieve_passages

#: Fixed values.
STOPWORDS = "và của là cho về theo trong được các những một khi để với hay tại đến này đó what which when where that from have about into your will does with this please".split()
LEAST_CHARS = 60


def question_terms(question: str) -> list[str]:
    return sorted({t.lower() for t in re.findall("[0-9A-Za-zÀ-ỹ]+", question) if len(t) >= 3 and t.lower() not in STOPWORDS})


def sentence_score(sentence: Column, terms: list[str]) -> Column:
    """Terms that the sentence holds, plus their share of its words."""
    low = F.lower(sentence)
    overlap = reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms], F.lit(0))
    return overlap + overlap / F.greatest(F.size(F.split(squeeze(sentence), " ")), F.lit(1))


def findings(passages: DataFrame, question: str, place: Column, limit: int = 3) -> DataFrame:
    """The best distinct sentences of 60 characters or more: (text, document_id, heading, score). ``place`` orders equal scores."""
    cut = passages.withColumn("place", place).select("place", "document_id", "heading", F.posexplode(F.split("text", r"(?<=[.;:!?])\s+")).alias("n", "s"))
    told = cut.select("place", "n", "document_id", "heading", strip(F.col("s")).alias("text")).where(F.length("text") >= LEAST_CHARS).withColumn("score", F.round(sentence_score(F.col("text"), question_terms(question)), 6))
    best = told.groupBy("text").agg(F.min(F.struct(-F.col("score"), "place", "n", "document_id", "heading")).alias("b"))
    return best.orderBy("b").limit(limit).select("text", F.col("b.document_id").alias("document_id"), F.col("b.heading").alias("heading"), (-F.col("b.col1")).alias("score"))


def sources(passages: DataFrame, place: Column, limit: int = 4) -> DataFrame:
    """The first distinct documents of the passages."""
    return passages.groupBy("document_id").agg(F.min(place).alias("place")).orderBy("place", "document_id").limit(limit)


def ask(pieces: DataFrame, index: Index, docs: DataFrame, document_index: Index, question: str, limit: int = 6, document_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, sources) of a question: the best passages are retrieved, and the sentences in them that answer best are taken out.

    Without ``document_id`` the passages are those of the documents that the
    question's weightier words find, and each document's rank counts.
    """
    if document_id is not None:
        one = docs.where(F.col("id") == document_id).select(F.col("id").alias("document_id"))
        ranks = None
    else:
        hits = match(document_index, query_prefixes(focus_query(question)), DOCUMENT_WEIGHTS).withColumnRenamed(document_index.key, "document_id")
        top = hits.orderBy("bm25", "document_id").limit(max(4 * limit, PAGE_SIZE))
        ranks = top.select("document_id", (F.row_number().over(Window.orderBy("bm25", "document_id")) - 1).alias("position"))  # a page of rows
        one = ranks.select("document_id")
    best = retrieve_passages(pieces, index, docs, question, limit, one, ranks)
    order = Window.orderBy(F.col("score").desc(), "document_id", "ordinal")  # at most ``limit`` rows
    shown = best.withColumn("place", F.row_number().over(order)).join(pieces.select("document_id", "ordinal", "text"), ["document_id", "ordinal"])
    return findings(shown.drop("score"), question, F.col("place")), sources(shown, F.col("place"))
