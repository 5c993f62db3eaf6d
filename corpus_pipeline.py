"""A corpus pipeline of five stages; each result is written as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns the columns of ``documents``; the last returns the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm import decontaminate, jaccard, language, linededup, packing
from lexweave.llm.durable import columns_like, durable
from lexweave.llm.queries import table, vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without a language (null text, or no letter in it) go.

    Repeated rows stay or go together, ties of entropy go to the first language
    by name, extra columns stay whatever their names, and an empty table gives
    an empty result.
    """
    model = language.fit(docs.where(~language.held_out()))
    lang, score = columns_like(docs, "lang_pred", "score")
    judged = language.identify(docs, model, "text", [F.col(c) for c in docs.columns], (lang, score))
    return judged.where(F.col(lang) != language.UNKNOWN).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: later repeated runs of lines go, and documents of which nothing is left; n_chars follows the text.

    Documents without text stay, repeated rows (equal id and text) are cut
    alike, of equal places the one of the least id and hash counts as first,
    and an empty table gives an empty result.
    """
    return linededup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on five-word shingles: of each group of near duplicates the document with the least id stays.

    SimHash fingerprints find candidates, and Jaccard similarity of 0.8 or more
    on the whole sets confirms them; similar pairs whose fingerprints lie
    beyond the radius are found by shared shingles, so that none is missed.
    Documents without an id stay; rows that share an id stay or go together.
    Texts without words are one group, empty and null alike. Extra columns stay
    whatever their names, and an empty table gives an empty result.
    """
    groups = jaccard.near_duplicates(docs.where("doc_id is not null").select("doc_id", "text"))
    gone = durable(groups.where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a benchmark item go.

    Null and empty texts hold none and stay, repeated rows stay or go together,
    and an empty table gives an empty result.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: what is left is packed into training sequences.

    Null texts count as empty, repeated rows are packed each, pieces of equal
    length are ordered by id, and an empty table gives an empty result.
    """
    return packing.pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage's rows can be told by SQL: they hang on learnt models, fingerprints, alignments and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
