import html
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.operators import search
from lexweave.schemas import METADATA
from lexweave.sources.corpus import VersionedTable, joined_strict, longest_content
from lexweave.streaming.ingest import import_batch, ingest, log_event, run_log, runs_table

DOCS = "id long, document_number string, title string, url string, legal_type string, legal_sectors string, issuing_authority string, issuance_date string, year int, signers string, content string, plain_content string, excerpt string, source string, source_hash string"


def metadata(spark, *ids):
    return spark.createDataFrame([(i, f"title {i}", "05/06/2014", f"{i}/2014/X", "Luật", "Bộ", None, None, "s", None, None) for i in ids], METADATA)


def test_stream_imports_each_document_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    content = spark.createDataFrame([(i, f"<p>text {i}</p>") for i in range(6)], "id long, content_html string")
    documents, runs = VersionedTable(spark, f"{base}/docs", DOCS, ["id"]), runs_table(spark, f"{base}/runs")
    metadata(spark, 0, 1, 2).coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert ingest(spark, f"{base}/in", content, documents, runs, f"{base}/cp", 2025) == (3, 3, 0)
    assert ingest(spark, f"{base}/in", content, documents, runs, f"{base}/cp", 2025) == (0, 0, 0)
    metadata(spark, 2, 3, 9).coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert ingest(spark, f"{base}/in", content, documents, runs, f"{base}/cp", 2025) == (2, 1, 1)
    assert sorted(r.id for r in documents.read().collect()) == [0, 1, 2, 3]
    log = run_log(runs.read()).orderBy("started_at").collect()
    assert [(r.scanned_count, r.imported_count, r.skipped_count) for r in log] == [(3, 3, 0), (0, 0, 0), (2, 1, 1)]
    assert all(r.finished_at is not None for r in log)


def test_failed_runs_are_logged(spark, tmp_path):
    runs = runs_table(spark, f"file://{tmp_path}/runs")
    log_event(runs, "r", "start", dataset_name="d")
    log_event(runs, "r", "failed", notes="failed=X")
    row = run_log(runs.read()).first()
    assert (row.dataset_name, row.notes) == ("d", "failed=X")


def test_changed_rows_only(spark, tmp_path):
    from lexweave.sources.corpus import records

    content = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content_html string")
    documents = VersionedTable(spark, f"file://{tmp_path}/docs", DOCS, ["id"])
    rows = records(metadata(spark, 1, 2), content, 2025)
    assert import_batch(documents, rows) == (2, 2, 0)
    assert import_batch(documents, rows) == (2, 0, 2)
    assert import_batch(documents, rows.withColumn("title", F.when(F.col("id") == 1, "new").otherwise(F.col("title")))) == (2, 1, 1)


def test_content_cache(spark):
    df = spark.createDataFrame([(1, "a"), (1, "abc"), (2, ""), (3, None), (4, "x")], "id long, content_html string")
    assert sorted(map(tuple, longest_content(df).collect())) == [(1, "abc"), (4, "x")]
    with pytest.raises(Exception, match="ids differ"):
        joined_strict(spark.createDataFrame([(1, "a")], "id long, t string"), df.where("id > 1")).collect()


def test_folding_equals_python(spark):
    words = ["Nghị định", "ĐẤT ĐAI", "été", "Straße", "ﬁ", "Ünïcödé", "  x \n", "ạ̈", "ÿŸ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def plain(s):
        s = unicodedata.normalize("NFKD", s.replace("đ", "d").replace("Đ", "D"))
        return "".join(c for c in s if not unicodedata.combining(c)).lower().strip()

    for r in df.select("w", text.ascii_fold(df.w).alias("f")).collect():
        if len(unicodedata.normalize("NFKD", r.w)) < 40 and "ﬁ" not in r.w:
            assert r.f == plain(r.w)


def test_entities_equal_the_library(spark):
    raw = "a &amp;lt; b &lt;c&gt; &quot;d&quot; &middot;&copy;&nbsp;e"
    assert spark.range(1).select(text.unescape_entities(F.lit(raw))).first()[0] == html.unescape(raw)


def test_search_cascade(spark, tmp_path):
    docs = spark.createDataFrame([(1, "12/2014/X", "thuế đất", "luật", "bộ", 2014, "01/01/2014", "nội dung thuế", "x"), (2, "7/2015/Y", "khác", "luật", "bộ", 2015, "01/01/2015", "thuế khác", "y")], "id long, document_number string, title string, legal_type string, issuing_authority string, year int, issuance_date string, content string, excerpt string")
    index = search.build_index(docs, "id", list(search.DOCUMENT_WEIGHTS))
    index.write(f"file://{tmp_path}/ix")
    stored = search.Index.read(spark, f"file://{tmp_path}/ix", "id", index.columns)
    run = lambda q, **k: [(r.tier, r.id) for r in search.search_documents(docs, stored, q, **k).collect()]
    assert run("") == [("browse", 2), ("browse", 1)]
    assert run("12-2014") == [("identifier", 1)]
    assert [i for _, i in run("thue")] == [1, 2]
    assert run("thue", year=2015) == [("words", 2)]
    assert run("zzz") == []
    profile = search.build_index(docs.select("id", F.lit("zzz").alias("keyword_index")), "id", ["keyword_index"])
    assert {t for t, _ in run("zzz", profile=profile)} == {"profile"}
    assert search.focus_query("quy định về thuế đất 2014") == "thuế đất 2014"


def test_snippet_marks_the_best_window(spark):
    words = " ".join(["pad"] * 30 + ["Thuế", "đất"] + ["pad"] * 30)
    got = spark.range(1).select(search.snippet(F.lit(words), ["thue", "đat"], 6)).first()[0]
    assert "<mark>Thuế</mark> <mark>đất</mark>" in got and got.startswith("... ") and got.endswith(" ...")
