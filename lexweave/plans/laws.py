"""A corpus of laws over the whole documents table, in SQL that Spark and DuckDB read alike.

Every document becomes a law whose number, headings and references follow from
its id, around its own text without digits. So what an operator must find is
known from the ids alone: document ``i`` cites ``i - 7`` in its preamble (from 7
on), amends the first article of ``i - 4`` in its second article (from 4 on),
and every fifth amends ``i - 5`` by its title (from 5 on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kind(e: str) -> str:
    return f"CASE ({e}) % 4 WHEN 0 THEN 'Nghị định' WHEN 1 THEN 'Thông tư' WHEN 2 THEN 'Quyết định' ELSE 'Luật' END"


def hint(e: str) -> str:
    """The type as a folded reference names it."""
    return f"CASE ({e}) % 4 WHEN 0 THEN 'nghi dinh' WHEN 1 THEN 'thong tu' WHEN 2 THEN 'quyet dinh' ELSE 'luat' END"


def year(e: str) -> str:
    return f"(1990 + ({e}) % 30)"


def number(e: str) -> str:
    return f"concat(CAST({e} AS STRING), '/', CAST({year(e)} AS STRING), '/', CASE ({e}) % 4 WHEN 0 THEN 'NĐ-CP' WHEN 1 THEN 'TT-BTC' WHEN 2 THEN 'QĐ-UBND' ELSE 'QH13' END)"


def plain_number(e: str) -> str:
    return f"concat(CAST({e} AS STRING), '/', CAST({year(e)} AS STRING), '/', CASE ({e}) % 4 WHEN 0 THEN 'nd-cp' WHEN 1 THEN 'tt-btc' WHEN 2 THEN 'qd-ubnd' ELSE 'qh13' END)"


def typed_number(e: str) -> str:
    """A typed reference ends before the hyphen."""
    return f"concat(CAST({e} AS STRING), '/', CAST({year(e)} AS STRING), '/', CASE ({e}) % 4 WHEN 0 THEN 'nd' WHEN 1 THEN 'tt' WHEN 2 THEN 'qd' ELSE 'qh13' END)"


def issuer(e: str) -> str:
    return f"CASE ({e}) % 4 WHEN 0 THEN 'Chính phủ' WHEN 1 THEN 'Bộ Tài chính' WHEN 2 THEN CASE WHEN CAST(floor(({e}) / 8) AS BIGINT) % 2 = 0 THEN 'UBND tỉnh Hà Giang' ELSE 'UBND tỉnh Hà Nam' END ELSE 'Quốc hội' END"


#: Strings that differ by what their date lacks; 2024 is the last sane year.
DATE = f"""CASE id % 8 WHEN 0 THEN concat(dm, y) WHEN 1 THEN concat(dm, CAST(1000 + {year('id')} AS STRING)) WHEN 2 THEN concat(dm, '0214') WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN concat('31/02/', y) WHEN 6 THEN concat(' ', dm, y, ' ') END"""
TAIL = "'[ \n\t\r]+$'"

LAWS = f"""laws AS (SELECT *, concat(CASE WHEN id >= 7 THEN concat(c0, chr(10)) ELSE '' END, c1, chr(10), CASE WHEN id >= 4 THEN concat(c2, chr(10)) ELSE '' END, 'Chương II QUY ĐỊNH CHUNG', chr(10), 'Điều 3. Hiệu lực') AS content, {DATE} AS raw_date
FROM (SELECT doc_id AS id, lang, source, {kind('doc_id')} AS legal_type, {number('doc_id')} AS document_number, {issuer('doc_id')} AS issuing_authority, CAST({year('doc_id')} AS INT) AS year, CAST({year('doc_id')} AS STRING) AS y,
 concat(lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), '/', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '/') AS dm, concat(lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), '/', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '/', CAST({year('doc_id')} AS STRING)) AS issuance_date,
 CASE WHEN doc_id % 5 = 0 AND doc_id >= 5 THEN concat('Sửa đổi ', {kind('doc_id - 5')}, ' ', {number('doc_id - 5')}) ELSE concat({kind('doc_id')}, ' về thuế ', coalesce(lang, ''), ' ', CAST(doc_id AS STRING)) END AS title,
 concat('Căn cứ ', {kind('doc_id - 7')}, ' số ', {number('doc_id - 7')}, ' ngày 01/02/', CAST({year('doc_id - 7')} AS STRING), ';') AS c0, regexp_replace(concat('Điều 1. Phạm vi', chr(10), translate(coalesce(text, ''), '0123456789#', '')), {TAIL}, '') AS c1,
 concat('Điều 2. Sửa đổi khoản 1 Điều 1 ', {kind('doc_id - 4')}, ' ', {number('doc_id - 4')}) AS c2, CASE doc_id % 3 WHEN 0 THEN 'Tài chính | Thuế' WHEN 1 THEN 'Lao động' ELSE '' END AS legal_sectors FROM {{documents}}) x)"""

#: Where a section stands: behind the title, and behind the preamble if there is one.
FIRST = "(CASE WHEN id >= 7 THEN 2 ELSE 1 END)"
SECTIONS = f"""secs AS (SELECT id AS document_id, 0 AS ordinal, 'title' AS section_type, 'Tiêu đề' AS label, 'tieu-de' AS anchor, '' AS text FROM laws
UNION ALL SELECT id, 1, 'preamble', 'Mở đầu', 'mở-đầu-1', c0 FROM laws WHERE id >= 7
UNION ALL SELECT id, {FIRST}, 'article', 'Điều 1.', 'điều-1-1', c1 FROM laws
UNION ALL SELECT id, {FIRST} + 1, 'article', 'Điều 2.', 'điều-2-1', c2 FROM laws WHERE id >= 4
UNION ALL SELECT id, {FIRST} + (CASE WHEN id >= 4 THEN 2 ELSE 1 END), 'chapter', 'Chương II QUY ĐỊNH CHUNG', 'chương-ii-quy-định-chung-1', 'Chương II QUY ĐỊNH CHUNG' FROM laws
UNION ALL SELECT id, {FIRST} + (CASE WHEN id >= 4 THEN 3 ELSE 2 END), 'article', 'Điều 3.', 'điều-3-1', 'Điều 3. Hiệu lực' FROM laws)"""


def _mentions() -> str:
    """Two of each reference: with its type, and by number alone."""
    places = [
        ("0", "id % 5 = 0 AND id >= 5", "id - 5", "NULL", "'sua doi'", "'amends'", "NULL"),
        ("1", "id >= 7", "id - 7", "NULL", "'can cu'", "'basis_for'", year("id - 7")),
        (f"{FIRST} + 1", "id >= 4", "id - 4", "'Khoản 1 Điều 1'", "'sua doi'", "'amends'", "NULL"),
    ]
    out = []
    for sec, where, target, label, cue, link, ref_year in places:
        # a typed reference wins where both end at one place, as they do for numbers without a hyphen
        for order, form, typed, more in ((1, typed_number(target), hint(target), ""), (2, plain_number(target), "NULL", f" AND ({target}) % 4 <> 3")):
            out.append(f"SELECT id AS source_document_id, {sec} AS section_ordinal, {order} AS mention_order, {form} AS referenced_number, CAST({label} AS STRING) AS referenced_label, {cue} AS cue_phrase, {link} AS link_type, CAST({typed} AS STRING) AS legal_type_hint, CAST({ref_year} AS INT) AS reference_year, {target} AS target FROM laws WHERE {where}{more}")
    return "ment AS (" + "\nUNION ALL ".join(out) + ")"


MENTIONS = _mentions()
#: A number of a local body is resolved only for a document of the same body; a typed reference lacks that part of the number.
CITATIONS = f"""cites AS (SELECT m.*, CASE WHEN referenced_label IS NOT NULL THEN CASE WHEN target >= 7 THEN 2 ELSE 1 END END AS target_section_ordinal FROM ment m JOIN laws t ON t.id = m.target JOIN laws s ON s.id = m.source_document_id
WHERE m.legal_type_hint IS NOT NULL OR m.target % 4 <> 2 OR t.issuing_authority = s.issuing_authority)"""
RELATIONS = "rels AS (SELECT s.id AS source_document_id, t.id AS target_document_id, 'amends' AS relation_type FROM laws s JOIN laws t ON t.id = s.id - 5 WHERE s.id % 5 = 0)"
VIEWS = {"laws": LAWS.format(documents="documents"), "secs": SECTIONS, "ment": MENTIONS, "cites": CITATIONS, "rels": RELATIONS}
NEEDS = {"laws": (), "secs": ("laws",), "ment": ("laws",), "cites": ("laws", "ment"), "rels": ("laws",)}


def sql(*names: str) -> str:
    """``WITH`` of the views named and those that they need."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*NEEDS[n], n) if x not in wanted]
    return "WITH " + ",\n".join(VIEWS[n] for n in wanted)


def laws(spark: SparkSession, d: str) -> DataFrame:
    """The corpus: id, document_number, title, legal_type, issuing_authority, year, issuance_date, raw_date, legal_sectors, content and the parts of it."""
    return spark.sql("WITH " + LAWS + " SELECT * FROM laws", documents=spark.read.parquet(f"{d}/documents.parquet"))
