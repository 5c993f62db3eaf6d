"""What a reader is shown of citations: references resolved on the fly, previews, and maps from numbers to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.legal import CITATION_ORDER, INVERSE_LABELS, LABELS, normalize_number, reference_quote
from ..functions.text import fts_fold, summarize, text_or_empty
from .resolve import resolve

MENTION = ["source_document_id", "section_ordinal", "mention_order"]


def needs_runtime(number: Column, hint: Column) -> Column:
    """Whether a reference is resolved when it is shown: it names a type, or its number has no slash."""
    return (text_or_empty(hint) != "") | ~text_or_empty(number).contains("/")


def runtime_links(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source_document_id, section_ordinal, mention_order, number, target_id) of the references that are resolved when shown."""
    asked = mentions.where(needs_runtime(F.col("referenced_number"), F.col("legal_type_hint")))
    asks = asked.select(F.struct(*MENTION).alias("ask"), F.col("source_document_id").alias("source_id"), F.col("referenced_number").alias("number"), F.col("legal_type_hint").alias("hint"), F.col("reference_year").alias("year"), F.col("reference_context").alias("context"))
    found = resolve(asks, docs).select("ask.*", "target_id")
    return found.join(mentions.select(*MENTION, normalize_number(F.col("raw_reference")).alias("number")), MENTION)


def runtime_support(docs: DataFrame, parts: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbers, anchors, labels): the first target of each number of a document, and how many references each anchor and label holds."""
    links = runtime_links(docs, mentions)
    numbers = links.groupBy(F.col("source_document_id").alias("document_id"), "number").agg(F.min_by("target_id", F.struct("section_ordinal", "mention_order")).alias("target_id"))
    placed = links.join(parts.select(F.col("document_id").alias("source_document_id"), F.col("ordinal").alias("section_ordinal"), "anchor", "label"), ["source_document_id", "section_ordinal"])
    counted = lambda c: placed.groupBy(F.col("source_document_id").alias("document_id"), c).agg(F.count("*").alias("links"))
    return numbers, counted("anchor"), counted("label")


def citation_map(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, number, target_id): linked documents by their folded numbers, outgoing groups before incoming.

    ``groups``: document_id, direction (0 outgoing, 1 incoming), type_order,
    item, linked_id. A linked document counts once, at its first place; of
    documents of one number the last counts.
    """
    first = groups.groupBy("document_id", "linked_id").agg(F.min(F.struct("direction", "type_order", "item")).alias("at"))
    named = first.join(docs.select(F.col("id").alias("linked_id"), fts_fold(F.col("document_number")).alias("number")), "linked_id").where("number != ''")
    return named.groupBy("document_id", "number").agg(F.max_by("linked_id", "at").alias("target_id"))


def best_mentions(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """The mention that answers each ask best: the asked anchor counts 4, the raw reference 3, its number 2, a label 1; the first of equals wins.

    ``rows``: source_document_id, target_document_id, section_ordinal,
    mention_order, anchor, raw_reference, referenced_number, referenced_label.
    ``asks``: source_document_id, target_document_id, ask_anchor, ask_raw.
    """
    pair = ["source_document_id", "target_document_id"]
    number = normalize_number(F.col("ask_raw"))
    point = lambda test, n: F.when(test, n).otherwise(0)
    score = point(F.col("anchor") == F.col("ask_anchor"), 4) + point(F.col("raw_reference") == F.col("ask_raw"), 3) + point((number != "") & (F.col("referenced_number") == number), 2) + point(text_or_empty(F.col("referenced_label")) != "", 1)
    scored = rows.join(asks, pair).withColumn("points", score)
    keep = ["section_ordinal", "mention_order", "anchor", "raw_reference", "referenced_number", "referenced_label"]
    best = F.min(F.struct(-F.col("points"), *keep)).alias("b")
    return scored.groupBy(*pair).agg(best).select(*pair, (-F.col("b.col1")).alias("points"), *[F.col(f"b.{c}").alias(c) for c in keep])


def incoming(links: DataFrame, docs: DataFrame, limit: int = 3) -> DataFrame:
    """(target_document_id, place, source_document_id, section_ordinal, link_type): each document's newest incoming mentions.

    Only the first ``limit`` of a target are ranked further: each task cuts its
    own rows before the shuffle, so a landmark's citers are never gathered.
    """
    named = links.join(docs.select(F.col("id").alias("source_document_id"), "year", "title"), "source_document_id")
    order = Window.partitionBy("target_document_id").orderBy(F.col("year").desc(), "title", "source_document_id", "section_ordinal", "mention_order")
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("target_document_id", "place", "source_document_id", "section_ordinal", "link_type")


def signals(relations: DataFrame, links: DataFrame) -> DataFrame:
    """(document_id, kind, link_type, count): what became of a document: updated by or changing another, and how often it is mentioned."""
    strong = relations.where(F.col("relation_type").isin("replaces", "amends"))
    first = F.max("relation_type").alias("link_type")  # replacing before amending
    updated = strong.groupBy(F.col("target_document_id").alias("document_id")).agg(first, F.count("*").alias("n")).select("document_id", F.lit("updated-by").alias("kind"), "link_type", "n")
    changes = strong.groupBy(F.col("source_document_id").alias("document_id")).agg(first, F.count("*").alias("n")).select("document_id", F.lit("changes-older").alias("kind"), "link_type", "n")
    place = F.array_position(F.array(*map(F.lit, CITATION_ORDER)), F.col("link_type"))
    cited = links.groupBy(F.col("target_document_id").alias("document_id")).agg(F.min_by("link_type", place).alias("link_type"), F.count("*").alias("n")).select("document_id", F.lit("mentioned-by").alias("kind"), "link_type", "n")
    return updated.unionByName(changes).unionByName(cited)


def label_of_link(c: Column, inverse: bool = False) -> Column:
    names = INVERSE_LABELS if inverse else LABELS
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), F.initcap(c))


def previews(graph: tuple[DataFrame, DataFrame, DataFrame], docs: DataFrame, asks: DataFrame) -> DataFrame:
    """One row per ask that a citation answers: the best mention with its section, quote and link, the target and its section.

    ``graph`` is what :func:`resolve.citation_graph` returns; ``asks`` as in :func:`best_mentions`.
    """
    parts, mentions, links = graph
    told = links.drop("link_type").join(mentions, MENTION)
    place = parts.select(F.col("document_id").alias("source_document_id"), F.col("ordinal").alias("section_ordinal"), "anchor", "label", "text")
    best = best_mentions(told.join(place.select("source_document_id", "section_ordinal", "anchor"), ["source_document_id", "section_ordinal"]), asks)
    full = best.drop("anchor", "raw_reference", "referenced_number", "referenced_label").join(told, [*MENTION, "target_document_id"]).join(place, ["source_document_id", "section_ordinal"])
    target = parts.select(F.col("document_id").alias("target_document_id"), F.col("ordinal").alias("target_section_ordinal"), F.col("label").alias("target_label"), F.col("anchor").alias("target_anchor"))
    named = docs.select(F.col("id").alias("target_document_id"), F.col("title").alias("target_title"), F.col("document_number").alias("target_number"))
    joined = full.join(target, ["target_document_id", "target_section_ordinal"], "left").join(named, "target_document_id")
    return joined.select(
        "source_document_id", "target_document_id", "points", F.col("label").alias("source_label"), F.col("anchor").alias("source_anchor"), summarize(F.col("text"), 180).alias("source_excerpt"), reference_quote(F.col("text"), F.col("raw_reference")).alias("quote"),
        "raw_reference", "referenced_number", "referenced_label", "link_type", label_of_link(F.col("link_type")).alias("link_label"), "confidence", "target_title", "target_number", "target_label", "target_anchor",
    )

