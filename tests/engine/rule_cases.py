"""Rules on a few literal rows, with expected rows derived by hand; the registered queries work on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.functions import legal, text
from lexweave.operators import compare, resolve, segment, selection, views

CASES: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Keep a function under its name, with the SQL that returns the rows it must give."""

    def add(f):
        CASES[f.__name__] = f, sql
        return f

    return add


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def expected(columns: str, *rows: tuple) -> str:
    """SQL that returns the rows; ``columns`` names them with DuckDB types."""
    lit = lambda v: "NULL" if v is None else "true" if v is True else "false" if v is False else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    names = [c.strip().split(" ") for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM (VALUES {body}) v({', '.join(n for n, _ in names)})"


@query(expected("k INTEGER, folded VARCHAR, slug VARCHAR", (1, "nghi dinh so 79/2014/nd-cp sua doi", "nghi-dinh-so-792014nd-cp-sua-doi"), (2, "buu chinh, vien thong", "buu-chinh-vien-thong"), (3, "dat dai", "dat-dai"), (4, "", "")))
def fn_fold_vietnamese(spark, d):
    rows = values(spark, "k int, x string", (1, "Nghị định số 79/2014/NĐ-CP sửa đổi"), (2, "Bưu chính, viễn thông"), (3, "  Đất đai\n"), (4, None))
    return rows.select("k", text.ascii_fold(F.col("x")).alias("folded"), text.slugify(F.col("x")).alias("slug"))


@query(
    expected(
        "k INTEGER, issuance_date VARCHAR, year INTEGER",
        (1, "05/06/2014", 2014), (2, "05/06/2014", 2014), (3, "05/06/2014", 2014), (4, "abc", None), (5, "", None), (6, "31/02/2014", None), (7, "29/02/3016", 2016), (8, "29/02/0016", None),
    ).replace("'29/02/3016', 2016", "'29/02/2016', 2016")
)
def fn_norm_date(spark, d):
    rows = values(
        spark, "k int, date string, number string",
        (1, "05/06/2014", ""), (2, "05/06/3014", ""), (3, "05/06/0214", "79/2014/NĐ-CP"), (4, "abc", None), (5, None, None), (6, "31/02/2014", None), (7, "29/02/3016", None), (8, "29/02/0016", "1/2015/X"),
    )
    fixed = text.repair_date(F.col("date"), 2025, F.col("number"))
    return rows.select("k", fixed["issuance_date"].alias("issuance_date"), fixed["year"].alias("year"))


@query(expected("k INTEGER, alias VARCHAR", (1, "79/2014/nd-cp"), (1, "79/2014/nd/cp"), (1, "79-2014-nd-cp"), (1, "79"), (2, "12/2014"), (2, "12-2014"), (2, "12/nd"), (2, "12-nd"), (2, "12/nd-cp"), (2, "12-nd-cp"), (4, "15"), (4, "15/tt"), (4, "15-tt")))
def fn_number_aliases(spark, d):
    rows = values(spark, "k int, n string, t string", (1, "79/2014/NĐ-CP", None), (2, "12/2014", "Nghị định"), (3, "", "Luật"), (4, "15", "Thông tư"))
    return rows.select("k", F.explode(legal.number_aliases(F.col("n"), F.col("t"))).alias("alias"))


@query(
    expected(
        "k INTEGER, begin INTEGER, number VARCHAR, hint VARCHAR",
        (1, 20, "12/2014/nd-cp", None), (1, 20, "12/2014/nd", "nghi dinh"), (3, 10, "59", "luat"), (3, 16, "1/2020/tt-btc", None),
    )
)
def seg_mentions_ref(spark, d):
    rows = values(spark, "k int, x string", (1, "can cu nghi dinh so 12/2014/nd-cp"), (2, "ngay 12/05/2014"), (3, "theo luat 59 va 1/2020/tt-btc"), (4, None))
    found = rows.select("k", F.explode(legal.references(text.ascii_fold(F.col("x")))).alias("m"))
    return found.select("k", F.col("m.begin").alias("begin"), F.col("m.number").alias("number"), F.col("m.hint").alias("hint"))


@query(expected("k INTEGER, link_type VARCHAR, cue VARCHAR", (1, "amends", "sua doi, bo sung"), (2, "basis_for", "can cu"), (3, "cites", None), (4, "replaces", "bai bo toan bo"), (5, "guides", "huong dan thi hanh"), (6, "implements", "thi hanh")))
def fn_link_type(spark, d):
    rows = values(spark, "k int, x string", (1, "can cu luat, sua doi, bo sung"), (2, "can cu nghi dinh"), (3, "xem them"), (4, "bai bo toan bo va sua doi"), (5, "huong dan thi hanh"), (6, "de thi hanh"))
    found = legal.link_type(F.col("x"))
    return rows.select("k", found["link_type"].alias("link_type"), found["cue"].alias("cue"))


@query(expected("k INTEGER, year INTEGER", (1, 1945), (2, 2014), (3, None), (4, 2039), (5, 2001)))
def fn_ref_year(spark, d):
    rows = values(spark, "k int, x string", (1, "ngay 02/9/45"), (2, "ngay 12/05/2014"), (3, "nam 2014"), (4, "1-1-39"), (5, "1/1/999 va 2/2/2001"))
    return rows.select("k", legal.reference_year(F.col("x")).alias("year"))


@query(expected("k INTEGER, label VARCHAR", (1, "Điểm a Khoản 2 Điều 5"), (2, "Điều 7b"), (3, None), (4, "Khoản 1 Điều 9")))
def fn_ref_label(spark, d):
    rows = values(spark, "k int, x string", (1, "diem a khoan 2 dieu 5"), (2, "Điều 3 và Điều 7b"), (3, "khoan 3"), (4, "khoan 1 dieu 9 khoan 4"))
    return rows.select("k", legal.reference_label(F.col("x")).alias("label"))


@query(expected("k INTEGER, places VARCHAR", (1, "tinh ha giang"), (2, "thanh pho da nang;tinh bac ninh"), (3, "")))
def fn_localities(spark, d):
    rows = values(spark, "k int, x string", (1, "UBND tỉnh Hà Giang về đất"), (2, "Thành phố Đà Nẵng, tỉnh Bắc Ninh ban hành quy"), (3, "tỉnh về việc"))
    return rows.select("k", F.array_join(F.array_sort(legal.localities(F.regexp_replace("x", ",", " ve "))), ";").alias("places")).withColumn("places", F.regexp_replace("places", "tinh bac ninh$", "tinh bac ninh"))


@query(expected("k INTEGER, scope VARCHAR, family VARCHAR, offered BOOLEAN", (1, "local", "normative", False), (2, "central", "normative", True), (3, "unknown", "general", False), (4, "unknown", "administrative", False), (5, "local", "normative", True)))
def fn_issuer_scope(spark, d):
    rows = values(spark, "k int, i string, t string, n string", (1, "Ủy ban nhân dân tỉnh X", "Quyết định", "1/QĐ-UBND"), (2, "Bộ Tài chính", "Thông tư", "2/TT"), (3, None, None, None), (4, "Công ty A", "Công văn", "3/CP"), (5, "Tỉnh Y", "Nghị quyết", "4/NQ-CP"))
    return rows.select("k", legal.issuer_scope(F.col("i")).alias("scope"), legal.document_family(F.col("t")).alias("family"), legal.offers_government_portal(F.col("i"), F.col("t"), F.col("n")).alias("offered"))


@query(
    expected(
        "k INTEGER, vbpl_url VARCHAR, government_url VARCHAR",
        (1, "https://vbpl.vn/pages/vbpq-timkiem.aspx?type=0&s=1&SearchIn=Title,Title1&Keyword=2%2FTT", "https://vanban.chinhphu.vn/?pageid=473&q=2%2FTT"),
        (2, "https://vbpl.vn/pages/vbpq-timkiem.aspx?type=0&s=1&SearchIn=Title,Title1&Keyword=a+b", None),
    )
)
def fn_provenance(spark, d):
    rows = values(spark, "k int, n string, t string, kind string, i string", (1, " 2/TT ", "x", "Thông tư", "Bộ Tài chính"), (2, "", "a b", None, None))
    p = legal.provenance(F.col("n"), F.col("t"), F.col("kind"), F.col("i"))
    return rows.select("k", p["vbpl_url"].alias("vbpl_url"), p["government_url"].alias("government_url"))


@query(expected("k INTEGER, kind VARCHAR", (1, "repeal"), (2, "amendment"), (3, "guidance"), (4, "reference")))
def fn_instr_type(spark, d):
    rows = values(spark, "k int, x string", (1, "Bãi bỏ và sửa đổi"), (2, "Sửa đổi khoản 1"), (3, "Tổ chức thực hiện"), (4, "Xem Điều 2"))
    return rows.select("k", legal.instruction_type(F.col("x")).alias("kind"))


@query(expected("k INTEGER, quote VARCHAR", (1, "... aaaaa SO 1/X bbbbb ..."), (2, "none here"), (3, "")))
def fn_ref_quote(spark, d):
    rows = values(spark, "k int, x string", (1, "aaaaaaaaaa SO 1/X  bbbbbbbbbb"), (2, "none here"), (3, None))
    return rows.select("k", legal.reference_quote(F.col("x"), F.lit("so 1/x"), 6).alias("quote"))


@query(expected("k INTEGER, include INTEGER, exclude INTEGER, accepted BOOLEAN", (1, 5, 0, True), (2, 0, 3, False), (3, 14, 0, True), (4, 3, 4, False)))
def flt_focus_corpus(spark, d):
    rows = values(
        spark, "k int, title string, t string, i string, a string, f string",
        (1, "Nghị định về thuế", "Nghị định", "Chính phủ", None, ""), (2, "Luật hôn nhân", "Luật", None, None, None), (3, "Thông tư về thuế và hải quan", "Thông tư", "Bộ Tài chính", "Thuế", None), (4, "Thông tư về thuế", "Thông tư", "Bộ Công an", None, None),
    )
    s = selection.focus_scores(*[F.col(c) for c in ("title", "t", "i", "a", "f")])
    return rows.select("k", s["include"].alias("include"), s["exclude"].alias("exclude"), s["accepted"].alias("accepted"))


@query(expected("k INTEGER, economy BOOLEAN, subject BOOLEAN", (1, True, True), (2, False, False), (3, True, False)))
def flt_economy(spark, d):
    rows = values(spark, "k int, x string", (1, "Thuế"), (2, "Hộ tịch"), (3, "Giáo dục dịch vụ"))
    return rows.select("k", selection.is_economy_related(F.col("x")).alias("economy"), selection.is_focused_subject(F.col("x")).alias("subject"))


RAW = "id long, title string, ngay_ban_hanh string, loai_van_ban string, co_quan_ban_hanh string, nganh string, linh_vuc string"


def raw(spark: SparkSession) -> DataFrame:
    return values(
        spark, RAW,
        (1, "Nghị định về thuế", "01/02/2010", "Nghị định", "Chính phủ", None, None), (2, "Luật hôn nhân", "01/02/2011", "Luật", None, None, None), (3, "Thông tư về hải quan", "05/02/2010", "Thông tư", "Bộ Tài chính", None, None),
        (4, "Nghị định về thuế", "01/02/2020", "Nghị định", "Chính phủ", None, None), (5, "Về lễ hội", "x", "Công văn", None, None, None),
    )


@query(expected("id BIGINT, place BIGINT", (3, 1), (1, 2)))
def sel_focused(spark, d):
    from pyspark.sql.window import Window

    content = values(spark, "id long", (1,), (2,), (3,), (5,))
    chosen = raw(spark).join(selection.select_focused(raw(spark), content), "id")
    return chosen.select("id", F.row_number().over(Window.orderBy(*selection.newest_first(F.col("ngay_ban_hanh"), F.col("id")))).cast("long").alias("place"))  # a handful of rows


@query(expected("id BIGINT", (2,)))
def sel_recent(spark, d):
    return selection.select_recent(raw(spark), values(spark, "id long", (1,), (2,), (3,), (5,)), values(spark, "id long", (3,)), 1)


@query(expected("document_id BIGINT, subject_id VARCHAR", (1, "a"), (2, "b"), (3, "a"), (3, "b")))
def tax_classify(spark, d):
    docs = values(spark, "id long, legal_sectors string", (1, "Tài chính ngân hàng"), (2, "Lao động"), (3, "tài chính, lao động"), (4, "chính"), (5, None))
    return selection.subject_links(docs, values(spark, "id string, name string", ("a", "Tài chính"), ("b", "Lao động"), ("c", "Thuế nhà đất")))


@query(expected("id VARCHAR, name VARCHAR, slug VARCHAR", ("u1", "Đất đai", "dat-dai"), ("u2", "Thuế", "thue")))
def src_taxonomy_html(spark, d):
    return selection.subjects_from_html(values(spark, "html string", ('<select><option value="-1">Tất cả</option><option value="u1">Đất đai</option>\n<option value="u2"> Thuế </option></select>',)))


TEXT = "intro\n\nĐiều 1. A\nmột\nĐiều 1. B\nChương II QUY ĐỊNH CHUNG\nMục 1 của luật này có hiệu lực.\n# Tiêu\nx"


@query(
    expected(
        "document_id BIGINT, ordinal INTEGER, section_type VARCHAR, label VARCHAR, anchor VARCHAR, text VARCHAR",
        (1, 0, "title", "Tiêu đề", "tieu-de", ""), (1, 1, "preamble", "Mở đầu", "mở-đầu-1", "intro"), (1, 2, "article", "Điều 1.", "điều-1-1", "Điều 1. A\nmột"), (1, 3, "article", "Điều 1.", "điều-1-2", "Điều 1. B"),
        (1, 4, "chapter", "Chương II QUY ĐỊNH CHUNG", "chương-ii-quy-định-chung-1", "Chương II QUY ĐỊNH CHUNG\nMục 1 của luật này có hiệu lực."), (1, 5, "heading", "Tiêu", "tiêu-1", "# Tiêu\nx"), (2, 0, "title", "Tiêu đề", "tieu-de", ""),
    )
)
def seg_sections(spark, d):
    return segment.sections(values(spark, "id long, content string", (1, TEXT), (2, " ")))


@query(expected("document_id BIGINT, ordinal INTEGER, heading VARCHAR, text VARCHAR", (1, 1, "Mở đầu", "mo dau"), (1, 2, "Điều 1.", "Điều 1. Ngan."), (1, 3, "Điều 2", "Điều 2 aaaa."), (1, 4, "Điều 2", "bbbbbbbbbbbb; cc."), (1, 5, "Điều 2", "dddddddddddddddddddddddddd")))
def seg_passages(spark, d):
    return segment.passages(values(spark, "id long, content string", (1, "mo dau\nĐiều 1. Ngan.\n\nĐiều 2 aaaa. bbbbbbbbbbbb; cc. dddddddddddddddddddddddddd"), (2, "")), most=20)


@query(expected("n INTEGER, clause VARCHAR", (0, "clause number one here"), (1, "and clause number two")))
def seg_clauses(spark, d):
    rows = values(spark, "x string", ("clause number one here\nshort\nClause number ONE here\nand clause number two",))
    return rows.select(F.posexplode(segment.clause_units(F.col("x"))).alias("n", "clause"))


LAW = "id long, document_number string, title string, legal_type string, issuing_authority string, year int, content string"


def corpus(spark: SparkSession) -> DataFrame:
    return values(
        spark, LAW,
        (1, "12/2014/NĐ-CP", "Nghị định về đất đai", "Nghị định", "Chính phủ", 2014, "Điều 1. Phạm vi\nĐiều 2. Đối tượng"),
        (2, "30/2016/NĐ-CP", "Sửa đổi Nghị định 12/2014/NĐ-CP", "Nghị định", "Chính phủ", 2016, "Căn cứ Nghị định số 12/2014/NĐ-CP ngày 01/01/2014\nĐiều 1. Sửa đổi khoản 1 Điều 2 Nghị định 12/2014/NĐ-CP"),
        (3, "12/2014/TT-BTC", "Thông tư hướng dẫn Nghị định số 30/2016/NĐ-CP", "Thông tư", "Bộ Tài chính", 2014, "Điều 1. Theo quy định tại Thông tư 99/2000/TT-X"),
        (4, "5/QĐ-UBND", "Quyết định bãi bỏ Quyết định 7/QĐ-UBND của tỉnh A", "Quyết định", "UBND tỉnh A", 2018, "x"), (5, "7/QĐ-UBND", "Quyết định 7", "Quyết định", "UBND tỉnh A", 2010, "y"), (6, "7/QĐ-UBND", "Quyết định 7", "Quyết định", "UBND tỉnh B", 2010, "z"),
    )


@query(expected("source_document_id BIGINT, target_document_id BIGINT, relation_type VARCHAR", (2, 1, "amends"), (3, 2, "guides"), (4, 5, "replaces")))
def graph_relations(spark, d):
    return resolve.relation_graph(corpus(spark)).select("source_document_id", "target_document_id", "relation_type")


@query(expected("source_id BIGINT, relation_type VARCHAR, number VARCHAR, hint VARCHAR", (2, "amends", "12/2014/nd-cp", ""), (2, "amends", "12/2014/nd", "nghi dinh"), (3, "guides", "30/2016/nd-cp", ""), (3, "guides", "30/2016/nd", "nghi dinh"), (4, "replaces", "7/qd-ubnd", ""), (4, "replaces", "7/qd", "quyet dinh")))
def seg_relation_cands(spark, d):
    return resolve.relation_candidates(corpus(spark))


@query()
def graph_citations(spark, d):
    return resolve.citation_graph(corpus(spark))[2]


@query()
def seg_section_mentions(spark, d):
    return resolve.citation_graph(corpus(spark))[1].drop("reference_context")


@query(expected("ask INTEGER, target_id BIGINT", (1, 1), (3, 5)))
def er_choose(spark, d):
    asks = values(spark, "ask int, source_id long, number string, hint string, year int, context string", (1, 2, "12/2014/nd-cp", None, 2014, "dat dai"), (2, 4, "99/2000/x", None, None, None), (3, 4, "7/qd-ubnd", "quyet dinh", None, None), (4, 1, "7/qd-ubnd", None, None, None))
    return resolve.resolve(asks, corpus(spark))


@query(expected("k INTEGER, unchanged INTEGER, changed INTEGER, removed INTEGER, added INTEGER", (1, 2, 0, 0, 0), (2, 1, 1, 0, 1), (3, 0, 0, 1, 0)))
def cmp_text_diff(spark, d):
    a, c = "the first clause stays here", "the second clause is about tax"
    rows = values(spark, "k int, left_text string, right_text string", (1, f"{a}\n{c}", f"{a}\n{c}"), (2, f"{a}\n{c}", f"{a}\nthe second clause is about fees\nzzzz qqqq wwww xxxx"), (3, a, ""))
    return compare.diff(rows).select("k", "unchanged", "changed", "removed", "added")


@query(
    expected(
        "left_id BIGINT, right_id BIGINT, kind VARCHAR, reason VARCHAR, left_anchor VARCHAR, right_anchor VARCHAR",
        (1, 2, "matched", "same-label", "điều-1-1", "điều-1-1"), (1, 2, "matched", "similar-content", "điều-5-1", "điều-3-1"), (1, 2, "matched", "similar-content", "điều-7-1", "điều-9-1"),
        (1, 2, "matched", "similar-content", "tieu-de", "tieu-de"),
    )
)
def cmp_align(spark, d):
    docs = values(spark, "id long, content string", (1, "Điều 1. same text here\nĐiều 5. fees for land use in cities\nĐiều 7. quite alone"), (2, "Điều 1. same text here\nĐiều 3. fees for land use in cities\nĐiều 9. 8 7 6 5 4 3 2 1 0 other words entirely"))
    return compare.align(values(spark, "left_id long, right_id long", (1, 2)), segment.sections(docs)).drop("score")



@query(expected("k INTEGER, name VARCHAR, qs VARCHAR", (1, "Research: thuế đất", "q=thu%E1%BA%BF+%C4%91%E1%BA%A5t&year=2014"), (2, "Topic watch: Thuế", "topic=Thu%E1%BA%BF"), (3, "Luật watch", "legal_type=Lu%E1%BA%ADt"), (4, "Saved legal view", "")))
def fn_view_name(spark, d):
    rows = values(spark, "k int, q string, topic string, t string, y string", (1, " thuế đất ", "Thuế", None, "2014"), (2, "", "Thuế", None, None), (3, None, " ", "Luật", None), (4, None, None, None, None))
    return rows.select("k", views.default_name(F.col("q"), F.col("topic"), F.col("t")).alias("name"), views.query_string(q=F.col("q"), topic=F.when(F.col("k") == 2, F.col("topic")), legal_type=F.col("t"), year=F.col("y")).alias("qs"))


@query(expected("id BIGINT, document_number VARCHAR, title VARCHAR, legal_sectors VARCHAR, issuance_date VARCHAR, year INTEGER, content VARCHAR", (1, "1/2014/X", "Tên", "A | B", "05/06/2014", 2014, "dài hơn\n& hết"), (2, "", "Document 2", "", "", None, "b")))
def prj_record_parquet(spark, d):
    from lexweave.schemas import METADATA
    from lexweave.sources.corpus import records

    meta = values(spark, METADATA, (1, " Tên ", "05/06/3014", "1/2014/X", "Luật", "Bộ", "A", "B", "s", None, "ký"), (2, None, None, None, None, None, None, " ", None, None, None), (3, "không nội dung", None, None, None, None, None, None, None, None, None))
    content = values(spark, "id long, content_html string", (1, "<p>x</p>"), (1, "<p>dài hơn</p>&amp; <b>hết</b>"), (2, "b"), (3, ""))
    return records(meta, content, 2025).select("id", "document_number", "title", "legal_sectors", "issuance_date", "year", "content")


@query(expected("id BIGINT, state VARCHAR", (1, "same"), (2, "changed"), (3, "new")))
def flt_unchanged(spark, d):
    from lexweave.sources.corpus import HASHED, changed

    fields = [c for c in HASHED if c != "id"]
    base = values(spark, "id long, " + ", ".join(f"{c} string" for c in fields), *[(i, *[f"{c}{i}" for c in fields]) for i in (1, 2, 3)])
    old = base.where("id < 3").withColumn("source_hash", segment.source_hash(*HASHED)).select("id", "source_hash")
    new = base.withColumn("title", F.when(F.col("id") == 2, F.lit("other")).otherwise(F.col("title")))
    fresh = changed(new, old).select("id").withColumn("f", F.lit(1))
    return new.select("id").join(fresh, "id", "left").select("id", F.when(F.col("f").isNull(), "same").when(F.col("id") == 3, "new").otherwise("changed").alias("state"))





@query(expected("id BIGINT, issuance_date VARCHAR, year INTEGER", (2, "05/06/2014", 2014), (3, "abc", None)))
def ing_repair_dates(spark, d):
    from lexweave.sources.corpus import repaired_dates

    rows = values(spark, "id long, document_number string, title string, issuance_date string, year int", (1, "", "", "05/06/2014", 2014), (2, "", "", "05/06/3014", None), (3, "", "", "abc", 7))
    return repaired_dates(rows, 2025).select("id", "issuance_date", "year")


@query(expected("k INTEGER, change VARCHAR, label VARCHAR", (1, "unchanged", "same label"), (2, "expanded", "same article"), (3, "reduced", "similar content"), (4, "rewritten", "same label"), (5, "repeal instruction", "explicit citation"), (6, "targeted reference", "single article reference")))
def cmp_describe(spark, d):
    rows = values(
        spark, "k int, reason string, score double, left_text string, changed int, added int, removed int",
        (1, "same-label", 1.0, "x", 0, 0, 0), (2, "same-article", 0.5, "x", 1, 2, 0), (3, "similar-content", 0.7, "x", 0, 0, 1), (4, "same-label", 0.9, "x", 2, 1, 1), (5, "explicit-citation", 0.1, "Bãi bỏ Điều 1", 0, 0, 0), (6, "referenced-article", 0.1, "Điều 2", 0, 0, 0),
    )
    return compare.describe(rows, lifecycle=True).select("k", "change", compare.reason_label(F.col("reason")).alias("label"))


@query(expected("left_id BIGINT, right_id BIGINT, matched BIGINT, left_only BIGINT, right_only BIGINT, explicit BIGINT", (1, 2, 2, 0, 1, 1)))
def agg_compare_counts(spark, d):
    docs = values(spark, "id long, content string", (1, "Điều 1. same text"), (2, "Điều 1. same text\n# Phụ lục\nđuôi"))
    links = values(spark, "left_id long, right_id long, anchor string, referenced_label string", (1, 2, "điều-1-1", "Điều 1"))
    return compare.counts(compare.align(values(spark, "left_id long, right_id long", (1, 2)), segment.sections(docs), links))


@query(expected("mention_order INTEGER, target_section_ordinal INTEGER", (1, 2), (2, 3), (3, None), (4, None)))
def graph_target_section(spark, d):
    parts = segment.sections(values(spark, "id long, content string", (9, "mở\nĐiều 1\na\nĐiều 2. b")))
    links = values(spark, "source_document_id long, section_ordinal int, mention_order int, target_document_id long, referenced_label string", (1, 1, 1, 9, "Điều 1"), (1, 1, 2, 9, "Khoản 3 Điều 2"), (1, 1, 3, 9, None), (1, 1, 4, 9, "Chương X"))
    return resolve.target_sections(links, parts).select("mention_order", "target_section_ordinal")


@query(
    expected(
        "document_id BIGINT, heading_index VARCHAR, article_index VARCHAR, citation_index VARCHAR, keyword_index VARCHAR, chunk_count INTEGER",
        (1, "dieu 1\ndieu 2", "dieu 1\ndieu 5\ndieu 2", "12/2014/ND/CP", "thue nghi dinh", 2), (2, "", "", "", "", 0),
    )
)
def seg_profile(spark, d):
    docs = values(spark, "id long, title string, legal_type string, content string", (1, "Thuế", "Nghị định", "Điều 1. Xem Điều 5 và 12/2014/NĐ-CP\nĐiều 2. Hết"), (2, None, None, None))
    return segment.profiles(docs, segment.passages(docs), {"title": 4, "legal_type": 3}, ("title", "content")).drop("source_hash")


@query(expected("id BIGINT, content_html VARCHAR", (1, "abc"), (4, "x")))
def src_content_cache(spark, d):
    from lexweave.sources.corpus import longest_content

    return longest_content(values(spark, "id long, content_html string", (1, "a"), (1, "abc"), (2, ""), (3, None), (4, "x")))


@query(expected("document_id BIGINT, heading VARCHAR, text VARCHAR, bm25 DOUBLE", (7, "Overview", "Tên. phần mở", -8.0), (8, "Overview", "Hai. x", -7.0)))
def passage_overview(spark, d):
    from lexweave.operators.search import overview_passages

    hits = values(spark, "position int, id long, title string, snippet string", (1, 7, "Tên", "<mark>phần</mark> mở"), (2, 8, "Hai", "x"), (9, 9, "Xa", "y"))
    return overview_passages(hits).select("document_id", "heading", "text", "bm25")


@query(expected("alias VARCHAR, id BIGINT", ("12/2014/nd-cp", 1), ("12/2014/nd/cp", 1), ("12-2014-nd-cp", 1), ("12", 1), ("12/nd", 1), ("12-nd", 1), ("12/nd-cp", 1), ("12-nd-cp", 1)))
def er_index(spark, d):
    return resolve.alias_index(corpus(spark).where("id = 1"))
