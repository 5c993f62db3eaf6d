"""Corpus relations over the synthetic tables, in the DataFrame API and in SQL, so that both engines see the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

LAST_YEAR = 2024

SQL = {
    "docs": """docs AS (SELECT doc_id AS id, text AS content, split_part(text, chr(10), 1) AS title, lang AS legal_type, source AS issuing_authority, CAST(1990 + doc_id % 40 AS INTEGER) AS year,
 concat(doc_id % 500, '/', 1990 + doc_id % 40, '/', upper(lang)) AS document_number, concat(lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'), '/', lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0'), '/', 1990 + doc_id % 40) AS issuance_date,
 CASE WHEN length(x) <= 280 THEN x ELSE concat(rtrim(substr(x, 1, 277)), '...') END AS excerpt FROM (SELECT *, trim(replace(text, chr(10), ' ')) AS x FROM documents))""",
    "marks": "marks AS (SELECT doc_id AS document_id, make_timestamp(2024, 1, 1, CAST(doc_id % 24 AS BIGINT), CAST(doc_id % 60 AS BIGINT), 0.0) AS tracked_at FROM labels WHERE quality = 1)",
    "subjects": "subjects AS (SELECT n_nationkey AS id, n_name AS name FROM nation)",
    "bridge": "bridge AS (SELECT doc_id AS document_id, CAST(doc_id % 23 AS INTEGER) AS subject_id FROM documents UNION ALL SELECT doc_id, CAST(23 + doc_id % 2 AS INTEGER) FROM documents WHERE doc_id % 3 = 0)",
    "passages": "passages AS (SELECT conv_id * 1000 + turn AS pid, conv_id AS document_id, CAST(turn + 1 AS INTEGER) AS ordinal, role AS heading, text FROM conversations)",
    "links": "links AS (SELECT l_orderkey AS source_id, l_partkey AS target_id, CASE l_returnflag WHEN 'A' THEN 'amends' WHEN 'R' THEN 'replaces' ELSE 'cites' END AS link_type, l_linenumber AS section FROM lineitem)",
    "parts": "parts AS (SELECT p_partkey AS id, p_name AS title, p_brand AS issuance_date FROM part)",
}


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or 'file://' + tempfile.mkdtemp()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read back: made once, however often it is read."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.lit(1990) + F.col("doc_id") % 40
    two = lambda n: F.lpad((F.col("doc_id") % n + 1).cast("string"), 2, "0")
    flat = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("lang").alias("legal_type"), F.col("source").alias("issuing_authority"), year.cast("int").alias("year"),
        F.concat((F.col("doc_id") % 500).cast("string"), F.lit("/"), year.cast("string"), F.lit("/"), F.upper("lang")).alias("document_number"), F.concat(two(28), F.lit("/"), two(12), F.lit("/"), year.cast("string")).alias("issuance_date"),
        F.when(F.length(flat) <= 280, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, 277)), F.lit("..."))).alias("excerpt"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), (F.col("doc_id") % 24).cast("int"), (F.col("doc_id") % 60).cast("int"), F.lit(0))
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"), at.alias("tracked_at"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    one = d.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 23).cast("int").alias("subject_id"))
    return one.unionAll(d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"), (23 + F.col("doc_id") % 2).cast("int").alias("subject_id")))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pid"), F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("ordinal"), F.col("role").alias("heading"), "text")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "amends").when(F.col("l_returnflag") == "R", "replaces").otherwise("cites")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), kind.alias("link_type"), F.col("l_linenumber").alias("section"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("issuance_date"))


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
