"""The relational catalogue: lookups, lists, facets, counts and neighbours of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .search import sane_year


def by_ids(docs: DataFrame, ids: list[int]) -> DataFrame:
    """Documents in the order of ``ids``, with their position."""
    wanted = docs.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, position int")
    return docs.join(F.broadcast(wanted), "id").orderBy("position")  # as many rows as the caller names


def recent(docs: DataFrame, last_year: int, limit: int = 5) -> DataFrame:
    year = sane_year(last_year)
    return docs.orderBy(year.desc(), F.when(year.isNotNull(), F.col("issuance_date")).desc(), F.col("id").desc()).limit(limit)


def tracked(docs: DataFrame, marks: DataFrame, limit: int | None = 8) -> DataFrame:
    rows = docs.join(marks.withColumnRenamed("document_id", "id"), "id").orderBy(F.col("tracked_at").desc(), F.col("id").desc())
    return rows.limit(limit) if limit else rows


def set_tracking(marks: DataFrame, docs: DataFrame, document_id: int, on: bool, at: Column) -> DataFrame:
    """``marks`` with a document's mark added (once, if the document exists) or taken away."""
    if not on:
        return marks.where(F.col("document_id") != document_id)
    new = docs.where(F.col("id") == document_id).select(F.col("id").alias("document_id"), at.alias("tracked_at")).join(marks, "document_id", "left_anti")
    return marks.unionByName(new)


def stats(docs: DataFrame, last_year: int) -> DataFrame:
    """One row of corpus figures."""
    year = sane_year(last_year)
    return docs.agg(
        F.count("*").alias("documents"),
        F.countDistinct(F.when(F.coalesce("issuing_authority", F.lit("")) != "", F.col("issuing_authority"))).alias("issuers"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
    )


def full_stats(docs: DataFrame, last_year: int, marks: DataFrame, subjects: DataFrame, relations: DataFrame, links: DataFrame, views: DataFrame) -> DataFrame:
    """One row of all corpus figures; ``docs`` has imported_at."""
    year = sane_year(last_year)
    out = docs.agg(
        F.count("*").alias("document_count"), F.countDistinct(F.when(F.coalesce("issuing_authority", F.lit("")) != "", F.col("issuing_authority"))).alias("authority_count"),
        F.min(year).alias("min_year"), F.max(year).alias("max_year"), F.max("imported_at").alias("last_imported_at"),
    )
    for name, rows in (("tracked_count", marks), ("taxonomy_subject_count", subjects), ("relation_count", relations), ("citation_link_count", links), ("research_view_count", views)):
        out = out.join(rows.agg(F.count("*").alias(name)))  # one row each
    return out


def by_slug(subjects: DataFrame, slug: str) -> DataFrame:
    return subjects.where(F.col("slug") == slug)


def top_types(docs: DataFrame, limit: int = 6) -> DataFrame:
    named = docs.where(F.coalesce("legal_type", F.lit("")) != "")
    return named.groupBy("legal_type").agg(F.count("*").alias("documents")).orderBy(F.col("documents").desc(), "legal_type").limit(limit)


def newest_years(docs: DataFrame, last_year: int, limit: int = 20) -> DataFrame:
    return docs.select(sane_year(last_year).alias("year")).where("year is not null").distinct().orderBy(F.col("year").desc()).limit(limit)


def outline(passages: DataFrame, document_id: int, limit: int = 40) -> DataFrame:
    own = passages.where((F.col("document_id") == document_id) & (F.coalesce("heading", F.lit("")) != ""))
    return own.groupBy("heading").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal", "heading").limit(limit)


def section_citation_counts(sections: DataFrame, mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Links per section of every document, zero included."""
    keys = ["document_id", "section_ordinal"]
    counted = mentions.join(links.select(*keys, "mention_order", "target_document_id"), [*keys, "mention_order"], "left").groupBy(*keys).agg(F.count("target_document_id").alias("links"))
    return sections.join(counted, keys, "left").select(*keys, F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def subject_counts(subjects: DataFrame, bridge: DataFrame, keep: Column | None = None, limit: int | None = None) -> DataFrame:
    """Documents per subject, zero included: filtered first, then ordered and cut."""
    kept = subjects if keep is None else subjects.where(keep)
    counted = bridge.groupBy("subject_id").agg(F.count("*").alias("documents"))
    rows = kept.join(counted, kept["id"] == counted["subject_id"], "left").select("id", "name", F.coalesce("documents", F.lit(0)).cast("long").alias("documents")).orderBy(F.col("documents").desc(), "name", "id")
    return rows.limit(limit) if limit else rows


def grouped_links(links: DataFrame, docs: DataFrame, order: tuple[str, ...], outgoing: bool = True) -> DataFrame:
    """Per document, link type and linked document: count and distinct sections, with the rank of the group's items.

    ``links``: source_id, target_id, link_type, section.
    """
    here, there = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
    grouped = links.groupBy(F.col(here).alias("document_id"), "link_type", F.col(there).alias("linked_id")).agg(F.count("*").alias("mentions"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))
    named = grouped.join(docs.select(F.col("id").alias("linked_id"), "title", "issuance_date"), "linked_id")
    w = Window.partitionBy("document_id", "link_type").orderBy(F.col("mentions").desc(), F.col("issuance_date"), F.col("title"), F.col("linked_id"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("link_type"))
    return named.select("document_id", "link_type", place.cast("int").alias("type_order"), F.row_number().over(w).alias("item"), "linked_id", "mentions", "sections")


def neighbours(links: DataFrame) -> DataFrame:
    """(document_id, other_id) of undirected links: both directions as rows, so that the join stays an equi join."""
    forth = links.select(F.col("source_id").alias("document_id"), F.col("target_id").alias("other_id"))
    back = links.select(F.col("target_id").alias("document_id"), F.col("source_id").alias("other_id"))
    return forth.unionByName(back).where("document_id != other_id").distinct()


def related(docs: DataFrame, relations: DataFrame, citations: DataFrame, document_id: int, limit: int = 4) -> DataFrame:
    """Neighbours by relation, then by citation, then documents alike in type, issuer or year; the first ``limit``."""
    me = docs.where(F.col("id") == document_id).select(F.col("legal_type").alias("t"), F.col("issuing_authority").alias("i"), F.col("year").alias("y"))
    linked = lambda edges, tier: docs.join(neighbours(edges).where(F.col("document_id") == document_id).select(F.col("other_id").alias("id")), "id", "left_semi").select("id", "title", "year", F.lit(tier).alias("tier"), F.lit(0).alias("gap"))
    one, two = linked(relations, 1), linked(citations, 2)
    like = docs.where(F.col("id") != document_id).join(F.broadcast(me), (F.col("legal_type") == F.col("t")) | (F.col("issuing_authority") == F.col("i")) | (F.col("year") == F.col("y")))  # ``me`` is one row
    three = like.select("id", "title", "year", F.lit(3).alias("tier"), F.abs(F.coalesce("year", F.lit(0)) - F.coalesce("y", F.lit(0))).alias("gap"))
    order = [F.col("tier"), F.col("gap"), F.when(F.col("tier") < 3, F.col("year")).desc(), F.col("title"), F.col("id")]
    tops = [df.orderBy(*order).limit(2 * limit) for df in (one, two, three)]
    return tops[0].unionByName(tops[1]).unionByName(tops[2]).groupBy("id", "title").agg(F.min(F.struct("tier", "gap", "year")).alias("s")).select("id", "title", "s.*").orderBy(*order).limit(limit).select("id", "title", "tier")


def same_subject(docs: DataFrame, bridge: DataFrame, limit: int = 3) -> DataFrame:
    """For every document, the newest others of a shared subject that are no older: (document_id, place, other_id).

    Only the newest few of each subject and year can be among them, so each
    subject is cut to its newest ``limit`` + 1 documents before the self join:
    no pairs within a subject are made.
    """
    full = bridge.join(docs.select(F.col("id").alias("document_id"), "year", "issuance_date", "title"), "document_id")
    newest = Window.partitionBy("subject_id").orderBy(F.col("year").desc(), F.col("issuance_date").desc(), F.col("title"), F.col("document_id"))
    heads = full.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= limit + 1).select("subject_id", F.col("document_id").alias("other_id"), F.col("year").alias("other_year"), F.col("issuance_date").alias("other_date"), F.col("title").alias("other_title"))
    pairs = full.join(heads, "subject_id").where((F.col("document_id") != F.col("other_id")) & (F.col("other_year") >= F.coalesce("year", F.lit(0))))
    each = pairs.select("document_id", "other_id", "other_year", "other_date", "other_title").distinct()
    w = Window.partitionBy("document_id").orderBy(F.col("other_year").desc(), F.col("other_date").desc(), F.col("other_title"), F.col("other_id"))
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("document_id", "place", "other_id")


def compare_targets(relations: DataFrame, citations: DataFrame) -> DataFrame:
    """For every linked document, the one to compare it with: incoming replacements and amendments first, then outgoing, then citations."""
    strong = relations.where(F.col("link_type").isin("replaces", "amends"))
    tiers = [
        strong.select(F.col("target_id").alias("document_id"), F.lit(1).alias("tier"), F.col("source_id").alias("other_id")),
        strong.select(F.col("source_id").alias("document_id"), F.lit(2).alias("tier"), F.col("target_id").alias("other_id")),
        citations.select(F.col("target_id").alias("document_id"), F.lit(3).alias("tier"), F.col("source_id").alias("other_id")),
        citations.select(F.col("source_id").alias("document_id"), F.lit(4).alias("tier"), F.col("target_id").alias("other_id")),
    ]
    every = tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).unionByName(tiers[3]).where("document_id != other_id")
    return every.groupBy("document_id").agg(F.min(F.struct("tier", "other_id")).alias("m")).select("document_id", "m.tier", "m.other_id")


def alerts(marks: DataFrame, relations: DataFrame, citations: DataFrame, updates: DataFrame) -> DataFrame:
    """Alerts on tracked documents: amended or replaced (high), guided or cited (medium), newer of the same subject (low)."""
    incoming = relations.select(F.col("target_id").alias("document_id"), F.when(F.col("link_type").isin("amends", "replaces"), "high").otherwise("medium").alias("severity"), F.concat(F.lit("lifecycle:"), "link_type").alias("kind"))
    cited = citations.select(F.col("target_id").alias("document_id"), F.lit("medium").alias("severity"), F.lit("citation").alias("kind"))
    newer = updates.select("document_id", F.lit("low").alias("severity"), F.lit("topic").alias("kind"))
    grouped = incoming.unionByName(cited).unionByName(newer).groupBy("document_id", "severity", "kind").agg(F.count("*").alias("targets"))
    rank = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("severity")).cast("int")
    return marks.join(grouped, "document_id").select(rank.alias("rank"), "document_id", "severity", "kind", "targets")
