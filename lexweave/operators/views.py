"""Saved searches of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import text_or_empty
from .search import Index, search_documents


def tidy(c: Column) -> Column:
    t = F.trim(text_or_empty(c))
    return F.when(t != "", t)


def latest(events: DataFrame, key: str = "id") -> DataFrame:
    """One row per view, the last event winning; deleted views go."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct("updated_at", "seq")).alias("v"))
    return last.select(key, "v.*").where("deleted = false")


def listing(views: DataFrame, limit: int = 12) -> DataFrame:
    return views.orderBy(F.col("updated_at").desc(), F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def default_name(query: Column, topic: Column, legal_type: Column) -> Column:
    """A name from what the view filters by: the query, else the topic, else the type."""
    q = F.trim(text_or_empty(query))
    return F.when(q != "", F.concat(F.lit("Research: "), F.substring(q, 1, 48))).otherwise(F.coalesce(F.concat(F.lit("Topic watch: "), tidy(topic)), F.concat(tidy(legal_type), F.lit(" watch")), F.lit("Saved legal view")))


def query_string(**fields: Column) -> Column:
    """The filters that are set, as a query string."""
    return F.concat_ws("&", *[F.when(tidy(c).isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(tidy(c)))) for k, c in fields.items()])


FIELDS = ("name", "query", "topic_slug", "legal_type", "issuer", "year")


def created(views: DataFrame, new: DataFrame) -> DataFrame:
    """``views`` with the rows of ``new`` (FIELDS, created_at): trimmed, blanks as null, numbered on behind the greatest id, named from what they filter by where they have no name."""
    fields = {c: tidy(F.col(c)) for c in ("topic_slug", "legal_type", "issuer")}
    name = F.coalesce(tidy(F.col("name")), default_name(F.col("query"), F.col("topic_slug"), F.col("legal_type")))
    shaped = new.select(name.alias("name"), F.trim(text_or_empty(F.col("query"))).alias("query"), *[v.alias(k) for k, v in fields.items()], F.col("year").cast("int").alias("year"), "created_at", F.col("created_at").alias("updated_at"))
    last = views.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.orderBy("created_at", "name", "query"))  # as many rows as users save at a time
    return views.unionByName(shaped.withColumn("place", place).join(F.broadcast(last)).select((F.col("last") + F.col("place")).alias("id"), *FIELDS, "created_at", "updated_at"))  # ``last`` is one row


def get(views: DataFrame, view_id: int) -> DataFrame:
    return views.where(F.col("id") == view_id)


def deleted(views: DataFrame, view_id: int) -> DataFrame:
    return views.where(F.col("id") != view_id)


def run(views: DataFrame, view_id: int, docs: DataFrame, index: Index, subjects: DataFrame, number: int = 1, last_year: int = 2100) -> DataFrame:
    """A saved view as a search: the topic's name goes before the query; an unknown view is an error."""
    row = get(views, view_id).first()
    if row is None:
        raise KeyError(view_id)
    topic = subjects.where(F.col("slug") == row["topic_slug"]).select("name").first() if row["topic_slug"] else None
    query = " ".join(x for x in (topic["name"] if topic else "", (row["query"] or "").strip()) if x)
    return search_documents(docs, index, query, number, last_year=last_year, legal_type=row["legal_type"], year=row["year"], issuer=row["issuer"])
