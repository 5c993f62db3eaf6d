"""These queries work on every row of their tables, not on a range of ids."""

import pytest

from lexweave.plans import catalog_queries, corpus_queries, pipeline_queries  # noqa: F401

DATA = "/root/testdata/sf0.01"
ROWS = {
    "sink_import_documents": ("documents", "doc_id % 5 <> 0", 1),
    "agg_section_citations": ("orders", "true", 4),
    "tracked_ids": ("labels", "quality = 1", 1),
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows(spark, name):
    table, where, times = ROWS[name]
    want = spark.read.parquet(f"{DATA}/{table}.parquet").where(where).count() * times
    assert catalog_queries.QUERIES[name](spark, DATA).count() == want


def test_subjects_of_every_document(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").distinct().count()
    got = catalog_queries.QUERIES["document_subjects"](spark, DATA)
    assert got.select("document_id").distinct().count() == n


def test_numbers_without_type(spark):
    """A number that a typed reference holds to its end is that reference's, not one by number alone."""
    got = catalog_queries.QUERIES["seg_numbers"](spark, DATA)
    ids = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert sorted(r.id for r in got.collect()) == sorted(i for i in ids if i >= 7 and (i - 7) % 4 != 3)
