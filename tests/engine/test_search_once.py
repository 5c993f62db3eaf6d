"""A search over tables that are not indexed yet cuts each row into tokens once, without postings; snippets fold a text as a whole."""

from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.operators import search

ROWS = [(1, "Thuế đất", "of the of thetis, ofr"), (2, "The of", "ĐẤT the ƠF"), (3, "x", None), (4, "often", "then 12 thé")]


def test_equal_to_postings(spark):
    docs = spark.createDataFrame(ROWS, "id long, title string, content string")
    kept = []
    index = search.build_index(docs, "id", ["title", "content"], lambda df, name: kept.append(name) or df)
    stored = search.Index(index.postings, index.lengths, "id", index.columns)
    for prefixes in (["of", "the"], ["thu"], ["zzz"], ["th", "th"], []):
        got, want = (sorted((r.id, round(r.bm25, 9)) for r in search.match(i, prefixes, search.DOCUMENT_WEIGHTS).collect()) for i in (index, stored))
        assert got == want
    assert kept == ["matches"] * 4


def test_snippet_folds_once(spark):
    docs = spark.createDataFrame([("a  Thể, thé x " + "y " * 20 + "thén Đ",), ("",), (None,)], "x string")
    shown = docs.select(search.snippet(F.col("x"), ["the"]).alias("s"))
    assert [r.s for r in shown.collect()] == ["a <mark>Thể,</mark> <mark>thé</mark> x y y y y y y y y y y y y ...", "", ""]
    plan = shown._jdf.queryExecution().analyzed().toString()
    assert "split(regexp_replace(lower(translate(" in plan.replace("\n", "")


def test_tokens_of_ascii_and_other_texts(spark):
    rows = spark.createDataFrame([("Ab1 c_d-E",), ("Ab1 c_d-É",), ("",), (None,)], "x string")
    assert [r.t for r in rows.select(text.fts_tokens(F.col("x")).alias("t")).collect()] == [["ab1", "c", "d", "e"], ["ab1", "c", "d", "e"], [], []]
