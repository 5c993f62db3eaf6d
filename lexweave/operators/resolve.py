"""Resolving references to documents, and the relation and citation graphs built from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.legal import RELATION_CUES, article_component, localities, normalize_number, number_aliases, number_parts, references, requires_local_context, type_hint
from ..functions.text import ascii_fold, find_all, plain_field, text_or_empty
from .segment import mentions, sections

SEGMENT = 420


def alias_index(docs: DataFrame) -> DataFrame:
    """(alias, id): every form under which a document's number may be cited."""
    return docs.where(text_or_empty(F.col("document_number")) != "").select(F.explode(number_aliases(F.col("document_number"), F.col("legal_type"))).alias("alias"), F.col("id"))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_fold(c), r"\s+"), lambda w: w != ""))


def resolve(asks: DataFrame, docs: DataFrame) -> DataFrame:
    """(ask, target_id) for references that one document answers; others have no row.

    ``asks``: ask (key), source_id, number, hint, year, context. Aliases of both
    sides are joined as keys (adaptive execution splits frequent ones). Then a
    funnel: each filter holds only where it leaves something, told by a window
    over the reference's candidates. What remains is decided by a unique
    issuer or a strictly best score, so no order of candidates matters.
    """
    named = docs.select("id", "document_number", "legal_type", "title", "issuing_authority", "year")
    forms = asks.select("ask", "source_id", F.explode(number_aliases(F.col("number"), F.col("hint"))).alias("alias"))
    pairs = forms.join(alias_index(docs), "alias").where("id != source_id").select("ask", "id").distinct()
    own = named.select(F.col("id").alias("source_id"), F.col("title").alias("s_title"), F.col("issuing_authority").alias("s_issuer"))
    full = pairs.join(named, "id").withColumnRenamed("year", "c_year").join(asks, "ask").join(own, "source_id", "left")
    hint, s_issuer, c_issuer = type_hint(F.col("hint")), ascii_fold(F.col("s_issuer")), ascii_fold(F.col("issuing_authority"))
    s_places = localities(F.concat_ws(" ", "s_title", "s_issuer"))
    c_places = localities(F.concat_ws(" ", "title", "issuing_authority"))
    valid = F.when(~requires_local_context(normalize_number(F.col("number"))), True).when((s_issuer != "") & (c_issuer != ""), s_issuer == c_issuer).when(F.size(s_places) > 0, F.arrays_overlap(s_places, c_places)).otherwise(True)
    parts = number_parts(normalize_number(F.col("document_number")))
    suffix = (F.get(parts, F.lit(0)) == F.get(number_parts(normalize_number(F.col("number"))), F.lit(0))) & (F.size(parts) > 1) & F.element_at(parts, -1).rlike("[a-z]")
    c = full.select("ask", "id", "hint", hint.alias("h"), type_hint(F.col("legal_type")).alias("ct"), "year", "c_year", valid.alias("valid"), F.coalesce(suffix, F.lit(False)).alias("suffix"), s_issuer.alias("si"), c_issuer.alias("ci"), "number", "document_number", "title", "issuing_authority", "s_title", "context")
    w = Window.partitionBy("ask")

    def funnel(df: DataFrame, flag: Column) -> DataFrame:
        return df.withColumn("f", flag).withColumn("any", F.max("f").over(w)).where("f or not any").drop("f", "any")

    c = funnel(c, (F.col("h") != "") & (F.col("ct") == F.col("h")))
    dated = F.coalesce(F.col("year").isNotNull() & (F.col("c_year") == F.col("year")) & F.col("valid"), F.lit(False))
    c = c.withColumn("same_year", dated).withColumn("n_year", F.sum(F.col("same_year").cast("int")).over(w))
    c = c.where("same_year or n_year = 0")
    c = funnel(c, (F.col("n_year") != 1) & (F.col("h") != "") & F.col("suffix"))
    issuer = F.coalesce((F.col("si") != "") & (F.col("ci") == F.col("si")) & F.col("valid"), F.lit(False))
    shared = lambda a, b: F.size(F.array_intersect(_words(F.col(a)), _words(F.col(b))))
    score = (
        shared("s_title", "issuing_authority")
        + F.when(F.col("ct") == F.col("h"), 5).otherwise(0)
        + F.when(F.coalesce(F.col("c_year") == F.col("year"), F.lit(False)), 6).otherwise(0)
        + F.when(F.array_contains(number_aliases(F.col("number"), F.col("hint")), normalize_number(F.col("document_number"))), 3).otherwise(0)
        + F.least(shared("context", "title"), F.lit(6))
    )
    c = c.withColumn("score", score).withColumn("n", F.count("*").over(w)).withColumn("issuer", issuer).withColumn("n_issuer", F.sum(F.col("issuer").cast("int")).over(w))
    c = c.withColumn("best", F.max("score").over(w)).withColumn("n_best", F.sum((F.col("score") == F.col("best")).cast("int")).over(w))
    chosen = (F.col("n_year") == 1) | ((F.col("n") == 1) & F.col("valid")) | ((F.col("n") > 1) & F.when(F.col("n_issuer") == 1, F.col("issuer")).otherwise((F.col("score") == F.col("best")) & (F.col("n_best") == 1) & F.col("valid")))
    return c.where(chosen).select("ask", F.col("id").alias("target_id"))


def relation_candidates(docs: DataFrame) -> DataFrame:
    """(source_id, relation_type, number, hint): references in the stretch behind each cue of a title."""
    folded = docs.select(F.col("id").alias("source_id"), ascii_fold(F.col("title")).alias("t"))

    def stretches(kind: str, cue: str) -> Column:
        return F.transform(find_all(F.col("t"), cue), lambda m: F.struct(F.lit(kind).alias("relation_type"), F.substring(F.col("t"), m["begin"] + 1, F.lit(SEGMENT)).alias("segment")))

    cues = [stretches(k, p) for k, patterns in RELATION_CUES.items() for p in patterns]
    hits = folded.select("source_id", F.inline(F.flatten(F.array(*cues))))
    found = hits.select("source_id", "relation_type", F.explode(references(F.col("segment"))).alias("m"))
    return found.select("source_id", "relation_type", F.col("m.number").alias("number"), F.coalesce("m.hint", F.lit("")).alias("hint")).distinct()


def relation_graph(docs: DataFrame) -> DataFrame:
    """Lifecycle relations between documents, read from their titles."""
    cands = relation_candidates(docs).withColumn("ask", F.struct("source_id", "relation_type", "number", "hint"))
    asks = cands.select("ask", "source_id", "number", F.when(F.col("hint") != "", F.col("hint")).alias("hint"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("context"))
    found = resolve(asks, docs).select(F.col("ask.source_id").alias("source_document_id"), F.col("target_id").alias("target_document_id"), F.col("ask.relation_type").alias("relation_type")).distinct()
    return found.join(docs.select(F.col("id").alias("source_document_id"), F.col("title").alias("evidence_text")), "source_document_id").select("source_document_id", "target_document_id", "relation_type", "evidence_text", F.lit("high").alias("confidence"))


def target_sections(links: DataFrame, parts: DataFrame) -> DataFrame:
    """``links`` (target_document_id, referenced_label, ...) with target_section_ordinal: equal label, else equal article, else one label inside the other."""
    labelled = parts.select(F.col("document_id").alias("target_document_id"), F.col("ordinal").alias("target_section_ordinal"), plain_field(F.col("label")).alias("own_label"), plain_field(article_component(F.col("label"))).alias("own_article"))
    wanted, article = plain_field(F.col("referenced_label")), plain_field(article_component(F.col("referenced_label")))
    asked = links.where(wanted != "").withColumn("wanted", wanted).withColumn("article", article)
    rank = F.when(F.col("own_label") == F.col("wanted"), 1).when((F.col("article") != "") & (F.col("own_article") == F.col("article")), 2).when(F.col("own_label").contains(F.col("wanted")) | F.col("wanted").contains(F.col("own_label")), 3)
    key = ["source_document_id", "section_ordinal", "mention_order", "target_document_id"]
    best = asked.join(labelled, "target_document_id").withColumn("rank", rank).where("rank is not null").groupBy(*key).agg(F.min(F.struct("rank", "target_section_ordinal")).alias("b"))
    return links.join(best.select(*key, F.col("b.target_section_ordinal").alias("target_section_ordinal")), key, "left")


def stored_or_found(links: DataFrame, parts: DataFrame) -> DataFrame:
    """``links`` (with stored, a section's ordinal or null, and target_section_ordinal as found by label) with the stored section where the document has it."""
    have = parts.select(F.col("document_id").alias("target_document_id"), F.col("ordinal").alias("stored"), F.lit(True).alias("there"))
    told = links.join(have, ["target_document_id", "stored"], "left")
    return told.withColumn("target_section_ordinal", F.when(F.col("there"), F.col("stored")).otherwise(F.col("target_section_ordinal"))).drop("there")


def citation_graph(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, mentions, links). A title section's text is the document's title; links are distinct.

    ``keep`` may store each table under a name, so that what is read more than
    once is made once.
    """
    parts = sections(docs).join(docs.select(F.col("id").alias("document_id"), "title"), "document_id").withColumn("text", F.when(F.col("ordinal") == 0, text_or_empty(F.col("title"))).otherwise(F.col("text"))).drop("title")
    parts = keep(parts, "sections")
    found = keep(mentions(parts, docs), "mentions")
    asks = found.select(F.struct("source_document_id", "section_ordinal", "mention_order").alias("ask"), F.col("source_document_id").alias("source_id"), F.col("referenced_number").alias("number"), F.col("legal_type_hint").alias("hint"), F.col("reference_year").alias("year"), F.col("reference_context").alias("context"))
    hits = keep(resolve(asks, docs), "resolved").select("ask.*", F.col("target_id").alias("target_document_id"))
    linked = hits.join(found.select("source_document_id", "section_ordinal", "mention_order", "link_type", "referenced_label"), ["source_document_id", "section_ordinal", "mention_order"])
    links = target_sections(linked, parts).select("source_document_id", "section_ordinal", "mention_order", "target_document_id", "target_section_ordinal", "link_type", F.lit(1.0).alias("score"), F.lit("document_number").alias("match_method"))
    return parts, found, keep(links, "links")
