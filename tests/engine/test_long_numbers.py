"""Numbers of more than four digits are cited as shorter ones are."""

from pyspark.sql import functions as F

from lexweave.functions import legal, text
from lexweave.operators import resolve


def test_typed_reference(spark):
    rows = spark.createDataFrame([("Căn cứ Nghị định số 10007/2007/NĐ-CP và Luật 123456/2005/QH13",)], "x string")
    found = rows.select(F.explode(legal.references(text.ascii_fold(F.col("x")))).alias("m")).select("m.number", "m.hint").collect()
    assert [tuple(r) for r in found] == [("10007/2007/nd", "nghi dinh"), ("10007/2007/nd-cp", None), ("123456/2005/qh13", "luat")]


def test_relation_by_typed_number(spark):
    """A local body's number with its last part is resolved for a document of the same body only; the typed form lacks that part."""
    docs = spark.createDataFrame([(1, "10010/2010/QĐ-UBND", "Quyết định", "Quyết định về thuế", "UBND tỉnh Hà Giang", 2010), (2, "10015/2015/QH13", "Luật", "Sửa đổi Quyết định 10010/2010/QĐ-UBND", "Quốc hội", 2015)], "id long, document_number string, legal_type string, title string, issuing_authority string, year int")
    assert [tuple(r) for r in resolve.relation_graph(docs).select("source_document_id", "target_document_id").collect()] == [(2, 1)]
