"""Markup marks lines where they stand: lines are not gathered again; lines that begin no section are told by their first word."""

from pyspark.sql import functions as F

from lexweave.operators import display, segment


def test_markup(spark):
    docs = spark.createDataFrame([(1, "Điều 1. a\n\nb\r\nChương II QUY ĐỊNH\nc"), (2, "mở\nĐiều 1. a"), (3, None), (4, "x\ny")], "id long, content string")
    got = display.markup(docs)
    assert "Window" in got._jdf.queryExecution().analyzed().toString()
    assert got._jdf.queryExecution().analyzed().toString().count("collect_list") == 2  # the lines of a section, and a document's anchors
    assert {r.document_id: r.content for r in got.collect()} == {
        1: '<a id="điều-1-1" class="anchor-target"></a>\nĐiều 1. a\n\nb\n<a id="chương-ii-quy-định-1" class="anchor-target"></a>\nChương II QUY ĐỊNH\nc',
        2: "mở\nĐiều 1. a", 3: "", 4: "x\ny",
    }


def test_labels(spark):
    lines = ["  # a", "# a", " ĐIỀU 3. x", "dieu 4a", "\tMục II TÊN", "phần a", "PHẦN A", "xĐiều 1", "Dieu", "", "Muc 2 TEN"]
    rows = spark.createDataFrame([(x,) for x in lines], "x string")
    whole = segment._line_label(F.col("x"), segment.strip(F.col("x")))
    for r in rows.select("x", segment.line_label(F.col("x")).alias("a"), whole.alias("b")).collect():
        assert r.a == r.b
