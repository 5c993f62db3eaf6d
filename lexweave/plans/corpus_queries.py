"""Queries over the corpus of laws: each operator on every document, with SQL that knows the answer from the ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import legal, text
from ..operators import catalog, compare, display, resolve, runtime, search, segment, selection, views
from ..schemas import struct
from . import bridge as b
from . import laws as w
from .catalog_queries import ORACLES, QUERIES, query

LAST = b.LAST_YEAR
laws = w.laws


def fold(c: str) -> str:
    return f"trim(lower(strip_accents(replace(replace(coalesce({c}, ''), 'đ', 'd'), 'Đ', 'D'))))"


def plain(c: str) -> str:
    return f"trim(regexp_replace({fold(c)}, '[^0-9a-z]+', ' ', 'g'))"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE concat(rtrim(substr({c}, 1, {n - 3})), '...') END"


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def on_laws(name: str, column: Callable[[], Column], sql: str) -> None:
    """Register a function of a law as a query (id, value)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return laws(spark, d).select("id", column().alias("value"))

    QUERIES[name] = run
    ORACLES[name] = w.sql("laws") + f" SELECT id, {sql} AS value FROM laws"


def joined(c: Column) -> Column:
    return F.array_join(c, " ; ")


# -- text, numbers, labels, dates ------------------------------------------------------------------

C = F.col
NUMBER = "regexp_replace(" + fold("document_number") + ", '[^0-9a-z/-]', '', 'g')"
FORMS = f"[{NUMBER}, replace({NUMBER}, '-', '/'), replace({NUMBER}, '/', '-'), CAST(id AS VARCHAR)]"
ABBREVIATIONS = "CASE id % 4 WHEN 0 THEN ['nd', 'nd-cp'] WHEN 1 THEN ['tt'] WHEN 2 THEN ['qd', 'qd-ttg', 'qd-ubnd'] ELSE ['qh'] END"
ALIASES = f"list_distinct(list_concat({FORMS}, flatten(list_transform({ABBREVIATIONS}, lambda a: [concat(id, '/', a), concat(id, '-', a)]))))"
ARTICLES = "CASE WHEN id >= 4 THEN ['dieu 1', 'dieu 2', 'dieu 3'] ELSE ['dieu 1', 'dieu 3'] END"
SCOPE = "CASE id % 4 WHEN 2 THEN 'local' ELSE 'central' END"
OFFERED = "id % 4 <> 2"
Q = "replace(replace(url_encode(document_number), '%20', '+'), '~', '%7E')"
VBPL = f"concat('https://vbpl.vn/pages/vbpq-timkiem.aspx?type=0&s=1&SearchIn=Title,Title1&Keyword=', {Q})"
PORTAL = f"CASE WHEN {OFFERED} THEN concat('https://vanban.chinhphu.vn/?pageid=473&q=', {Q}) END"
HINTED = "CASE WHEN id BETWEEN 1900 AND 2024 THEN id ELSE 1990 + id % 30 END"
NEW_DATE = f"CASE id % 8 WHEN 1 THEN concat(dm, {HINTED}) WHEN 2 THEN concat(dm, {HINTED}) WHEN 7 THEN '' ELSE trim(raw_date) END"
NEW_YEAR = f"CASE id % 8 WHEN 0 THEN 1990 + id % 30 WHEN 6 THEN 1990 + id % 30 WHEN 1 THEN {HINTED} WHEN 2 THEN {HINTED} END"
proven = lambda: legal.provenance(C("document_number"), C("title"), C("legal_type"), C("issuing_authority"))

on_laws("fn_field_norm", lambda: text.plain_field(C("title")), plain("title"))
on_laws("fn_ascii_fold_v2", lambda: text.ascii_words(C("title")), f"trim(regexp_replace(regexp_replace({fold('title')}, '[^0-9a-z\\s/.-]', ' ', 'g'), '\\s+', ' ', 'g'))")
on_laws("fn_summarize", lambda: text.summarize(C("content")), cut(squeezed("content"), 220))
on_laws("fn_summarize2", lambda: text.summarize(C("content"), 180), cut(squeezed("content"), 180))
on_laws("fn_retr_norm", lambda: text.retrieval_text(C("title")), f"trim(regexp_replace(regexp_replace({fold('title')}, '[^0-9a-z/\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))")
on_laws("fn_unique_in_order", lambda: joined(text.unique_in_order(F.split(F.concat_ws(" ", "title", "title", "lang"), " "))), "array_to_string(list_filter(string_split(concat_ws(' ', title, title, lang), ' '), lambda x, i: x <> '' AND list_position(string_split(concat_ws(' ', title, title, lang), ' '), x) = i), ' ; ')")
on_laws("fn_number_norm", lambda: legal.normalize_number(C("document_number")), NUMBER)
on_laws("fn_type_norm", lambda: legal.type_hint(C("legal_type")), w.hint("id"))
on_laws("fn_type_norm2", lambda: text.ascii_fold(C("legal_type")), w.hint("id"))
on_laws("fn_number_parts", lambda: joined(legal.number_parts(legal.normalize_number(C("document_number")))), "concat(id, ' ; ', y, ' ; ', CASE id % 4 WHEN 0 THEN 'nd ; cp' WHEN 1 THEN 'tt ; btc' WHEN 2 THEN 'qd ; ubnd' ELSE 'qh13' END)")
on_laws("fn_type_abbr", lambda: joined(legal._abbreviations(C("legal_type"))), f"array_to_string({ABBREVIATIONS}, ' ; ')")
on_laws("fn_number_aliases", lambda: joined(F.array_sort(legal.number_aliases(C("document_number"), C("legal_type")))), f"array_to_string(list_sort({ALIASES}), ' ; ')")
on_laws("fn_sql_aliases", lambda: joined(legal.sql_number_aliases(C("document_number"), C("legal_type"))), f"array_to_string(list_sort(list_distinct(list_concat({ALIASES}, list_transform({ALIASES}, lambda a: upper(a))))), ' ; ')")
on_laws("fn_year", lambda: F.year(text.parsed_date(C("issuance_date"))), "CAST(1990 + id % 30 AS INTEGER)")
on_laws("fn_year_hint", lambda: text.year_hint(LAST, C("document_number"), C("title")), f"CAST({HINTED} AS INTEGER)")
on_laws("fn_max_year", lambda: text.last_sane_year(), "CAST(extract(year FROM current_date) + 1 AS INTEGER)")
on_laws("fn_ref_label", lambda: legal.reference_label(C("c2")), "'Khoản 1 Điều 1'")
on_laws("fn_ref_year", lambda: legal.reference_year(C("c0")), f"CAST({w.year('id - 7')} AS INTEGER)")
on_laws("fn_ref_quote", lambda: legal.reference_quote(C("c0"), C("document_number"), 6), cut(squeezed("c0"), 12))
on_laws("fn_link_type", lambda: F.concat_ws(":", legal.link_type(text.ascii_fold(C("c2")))["link_type"], legal.link_type(text.ascii_fold(C("c0")))["link_type"]), "'amends:basis_for'")
on_laws("fn_localities", lambda: joined(legal.localities(C("issuing_authority"))), "CASE WHEN id % 4 = 2 THEN CASE WHEN CAST(floor(id / 8) AS BIGINT) % 2 = 0 THEN 'tinh ha giang' ELSE 'tinh ha nam' END ELSE '' END")
on_laws("fn_requires_local", lambda: legal.requires_local_context(legal.normalize_number(C("document_number"))), "id % 4 = 2")
on_laws("fn_article_component", lambda: legal.article_component(C("c1")), "'Điều 1'")
on_laws("fn_article_label", lambda: F.regexp_extract(text.ascii_fold(C("c1")), r"\bdieu\s+\d+[a-z]?\b", 0), "'dieu 1'")
on_laws("fn_article_labels", lambda: joined(F.array_sort(legal.article_labels(C("content")))), f"array_to_string({ARTICLES}, ' ; ')")
on_laws("fn_target_articles", lambda: joined(F.array_except(legal.article_labels(C("c2")), F.array(F.lit("dieu 2")))), "'dieu 1'")
on_laws("fn_label_norm", lambda: text.plain_field(F.concat(F.lit("Điều "), C("id"), F.lit(". Khoản"))), "concat('dieu ', id, ' khoan')")
on_laws("fn_label_tokens", lambda: joined(F.array_sort(text.token_set(C("title")))), f"array_to_string(list_sort(list_distinct(regexp_extract_all({fold('title')}, '[0-9a-z]+'))), ' ; ')")
on_laws("fn_anchor", lambda: text.slug_anchor(C("legal_type")), "replace(lower(legal_type), ' ', '-')")
on_laws("fn_instr_type", lambda: legal.instruction_type(F.when(C("id") % 3 == 0, C("c2")).when(C("id") % 3 == 1, C("c0")).otherwise("Tổ chức thực hiện")), "CASE id % 3 WHEN 0 THEN 'amendment' WHEN 1 THEN 'reference' ELSE 'guidance' END")
on_laws("fn_doc_family", lambda: legal.document_family(C("legal_type")), "'normative'")
on_laws("fn_issuer_scope", lambda: legal.issuer_scope(C("issuing_authority")), SCOPE)
on_laws("fn_query_value", lambda: legal.query_value(F.when(C("id") % 2 == 0, C("document_number")), C("title")), "CASE WHEN id % 2 = 0 THEN document_number ELSE trim(title) END")
on_laws("fn_url_vbpl", lambda: proven()["vbpl_url"], VBPL)
on_laws("fn_url_vncp", lambda: proven()["government_url"], PORTAL)
on_laws("fn_offer_vncp", lambda: legal.offers_government_portal(C("issuing_authority"), C("legal_type"), C("document_number")), OFFERED)
on_laws("fn_provenance", lambda: F.concat_ws("|", *[proven()[k] for k in ("family_label", "headline", "scope_label", "vbpl_confidence", "government_confidence")]), f"concat_ws('|', 'Normative act', 'Strong official lookup routes available', CASE WHEN {SCOPE} = 'local' THEN 'Local issuer' ELSE 'Central issuer' END, 'high', CASE WHEN {OFFERED} THEN 'high' END)")
on_laws("fn_ident_norm", lambda: search.identifier_form(F.concat_ws(" ", "document_number", "lang")), "replace(upper(replace(concat_ws(' ', document_number, lang), ' ', '')), '-', '/')")
on_laws("fn_ident_probe", lambda: search.is_identifier(F.when(C("id") % 2 == 0, C("document_number")).when(C("id") % 3 == 0, C("content")).otherwise(C("lang"))), "CASE WHEN id % 2 = 0 THEN true ELSE false END")
on_laws("fn_reason_label", lambda: compare.reason_label(F.element_at(F.array(*map(F.lit, compare.REASONS)), (C("id") % len(compare.REASONS) + 1).cast("int"))), f"{listed(compare.REASONS.values())}[id % {len(compare.REASONS)} + 1]")
on_laws("fn_view_name", lambda: views.default_name(F.when(C("id") % 3 == 0, C("title")), F.when(C("id") % 3 == 1, C("lang")), C("legal_type")), "CASE id % 3 WHEN 0 THEN concat('Research: ', substr(trim(title), 1, 48)) WHEN 1 THEN concat('Topic watch: ', lang) ELSE concat(legal_type, ' watch') END")
on_laws("fn_view_qs", lambda: views.query_string(q=F.when(C("id") % 2 == 0, C("lang")), year=C("y")), "concat(CASE WHEN id % 2 = 0 THEN concat('q=', lang, '&') ELSE '' END, 'year=', y)")
on_laws("prj_sort_key", lambda: F.concat_ws("|", F.coalesce(F.year(text.parsed_date(C("issuance_date"))), F.lit(0)), F.coalesce(F.date_format(text.parsed_date(C("issuance_date")), "yyyyMMdd"), F.lit(""))), "concat(y, '|', y, split_part(dm, '/', 2), split_part(dm, '/', 1))")
on_laws("prj_enrich", lambda: F.concat_ws("|", C("title"), proven()["family"], proven()["scope"]), f"concat_ws('|', title, 'normative', {SCOPE})")
on_laws("flt_kw_wholeword", lambda: selection.whole_word_hits(text.plain_field(C("title")), ["thue", "sua doi", "nghi"]), "len(list_filter(['thue', 'sua doi', 'nghi'], lambda k: contains(concat(' ', " + plain("title") + ", ' '), concat(' ', k, ' '))))")
on_laws("flt_focus_type", lambda: selection.is_focus_type(C("legal_type")), f"list_contains({listed(selection.FOCUS_TYPES)}, {w.hint('id')})")
on_laws("flt_economy", lambda: selection.is_economy_related(C("title")), f"len(list_filter({listed(selection.ECONOMY_WORDS)}, lambda k: contains({fold('title')}, k))) > 0")
on_laws("flt_focus_subject", lambda: selection.is_focused_subject(C("legal_sectors")), f"len(list_filter({listed(selection.EXCLUDED_SUBJECTS)}, lambda k: contains({fold('legal_sectors')}, k))) = 0 AND len(list_filter({listed(selection.FOCUS_SUBJECTS)}, lambda k: contains({fold('legal_sectors')}, k))) > 0")
on_laws("seg_preamble", lambda: joined(display.preamble_clauses(F.concat_ws(" ", "c0", F.lit("Xét đề nghị của"), "lang"))), f"concat({squeezed('c0')}, ' ; Xét đề nghị của ', lang)")
on_laws("seg_preamble2", lambda: F.concat_ws(" ; ", display.title_and_preamble(F.concat_ws(" ", F.repeat(C("title"), 3), "c0"))["title"], display.title_and_preamble(F.concat_ws(" ", F.repeat(C("title"), 3), "c0"))["preamble"]), "CASE WHEN length(title) * 3 >= 48 THEN concat_ws(' ; ', repeat(title, 3), c0) ELSE concat_ws(' ', repeat(title, 3), c0) END")
on_laws("seg_display_paras", lambda: joined(display.paragraphs(F.concat(C("c0"), F.lit(" Điều 1. Một"), F.lit("\n \nhai "), C("lang"), F.lit(" Chương II ba")))), "concat(c0, ' ; Điều 1. Một ; hai ', lang, ' ; Chương II ba')")
on_laws("seg_table", lambda: F.to_json(display.table_block(F.concat(F.lit("| số | tên |\n|---|---|\n| "), C("document_number"), F.lit(" | "), C("lang"), F.lit(" |\n| a | b | c |\n||")))), "concat('{\"header\":[\"số\",\"tên\"],\"body\":[[\"', document_number, '\",\"', lang, '\"]]}')")
RAW = w.number("id - 7")
on_laws("seg_raw_refs", lambda: F.when(C("id") >= 7, joined(F.transform(display.raw_references(C("c0")), lambda r: F.concat(r["begin"], F.lit(":"), r["raw"])))), f"CASE WHEN id >= 7 THEN concat(strpos(c0, {RAW}) - 1, ':', {RAW}, ' ; ', strpos(c0, {RAW}) - 1, ':', {RAW}) END")
on_laws("rnd_best_match", lambda: display.best_match(C("document_number"), F.array(F.struct(F.lit("x/1").alias("number"), F.lit(1).cast("long").alias("id")), F.struct(display.reference_key(F.when(C("id") % 2 == 0, C("document_number")).otherwise(F.concat(C("document_number"), F.lit("/bis")))).alias("number"), C("id").alias("id"))))["id"], "id")
on_laws("rnd_links", lambda: display.linked(F.concat(F.lit("xem "), C("document_number"), F.lit(" va 1/1900/ZZ.")), F.array(F.struct(display.reference_key(C("document_number")).alias("number"), C("id").alias("id")))), "concat('xem <a href=\"/documents/', id, '\" class=\"doc-ref-link\" data-target-document-id=\"', id, '\" data-reference=\"', document_number, '\">', document_number, '</a> va 1/1900/ZZ.')")


@query(w.sql("laws") + f" SELECT id, CAST({NEW_DATE} AS VARCHAR) AS issuance_date, CAST({NEW_YEAR} AS INTEGER) AS year FROM laws")
def fn_norm_date(spark, d):
    fixed = text.repair_date(C("raw_date"), LAST, C("document_number"), C("title"))
    return laws(spark, d).select("id", fixed["issuance_date"].alias("issuance_date"), fixed["year"].alias("year"))


@query(w.sql("laws") + f", n AS (SELECT id, year, coalesce(raw_date, '') AS old, CAST({NEW_DATE} AS VARCHAR) AS issuance_date, CAST({NEW_YEAR} AS INTEGER) AS new_year FROM laws) SELECT id, issuance_date, new_year AS year FROM n WHERE issuance_date <> old OR new_year IS DISTINCT FROM year")
def ing_repair_dates(spark, d):
    from ..sources.corpus import repaired_dates

    rows = laws(spark, d).select("id", "document_number", "title", text.text_or_empty(C("raw_date")).alias("issuance_date"), "year")
    return repaired_dates(rows, LAST).select("id", "issuance_date", "year")


@query(w.sql("laws") + f", a AS (SELECT id, unnest({ALIASES}) AS alias FROM laws) SELECT alias, id FROM a")
def er_index(spark, d):
    return resolve.alias_index(laws(spark, d))


FOCUS_FIELD = "regexp_replace(" + plain("{}") + ", '\\s+', ' ', 'g')"


# -- sections, mentions, graphs --------------------------------------------------------------------


@query(w.sql("secs") + " SELECT * FROM secs")
def seg_sections(spark, d):
    return segment.sections(laws(spark, d))


@query(w.sql("secs") + " SELECT document_id, ordinal, section_type, label FROM secs WHERE section_type NOT IN ('title', 'preamble')")
def seg_detect(spark, d):
    return segment.sections(laws(spark, d)).where("section_type not in ('title', 'preamble')").select("document_id", "ordinal", "section_type", "label")


@query(w.sql("laws") + " SELECT id, unnest(['none', 'article', 'chapter', 'none', 'none']) AS kind, generate_subscripts([1, 2, 3, 4, 5], 1) AS place FROM laws")
def seg_structural(spark, d):
    lines = F.array(C("lang"), F.concat(F.lit("Điều "), C("id"), F.lit(". Tên")), F.lit("Chương IV QUY ĐỊNH"), F.concat(F.lit("Chương này "), C("lang"), F.lit(" có hiệu lực.")), F.lit("Mục 2; và mục 3"))
    rows = laws(spark, d).select("id", F.posexplode(lines).alias("k", "line"))
    return rows.select("id", F.coalesce(segment.line_label(C("line"))["section_type"], F.lit("none")).alias("kind"), (C("k") + 1).cast("long").alias("place"))


@query(w.sql("secs") + " SELECT document_id, ordinal, label, anchor FROM secs WHERE document_id = 11")
def sections_list(spark, d):
    return segment.sections(laws(spark, d).where("id = 11")).select("document_id", "ordinal", "label", "anchor")


@query(w.sql("secs") + " SELECT document_id, ordinal AS place, label AS heading, anchor FROM secs WHERE section_type IN ('article', 'chapter')")
def seg_outline(spark, d):
    return display.outline(segment.sections(laws(spark, d)))


ANCHORED = "concat('<a id=\"', {}, '\" class=\"anchor-target\"></a>', chr(10), {})"


@query(
    w.sql("laws")
    + " SELECT id AS document_id, concat("
    + ANCHORED.format("'điều-1-1'", "c1")
    + ", chr(10), CASE WHEN id >= 4 THEN concat("
    + ANCHORED.format("'điều-2-1'", "c2")
    + ", chr(10)) ELSE '' END, "
    + ANCHORED.format("'chương-ii-quy-định-chung-1'", "'Chương II QUY ĐỊNH CHUNG'")
    + ", chr(10), "
    + ANCHORED.format("'điều-3-1'", "'Điều 3. Hiệu lực'")
    + ") AS content FROM laws WHERE id < 7 UNION ALL SELECT id, content FROM laws WHERE id >= 7"
)
def seg_markup(spark, d):
    return display.markup(laws(spark, d))


@query(w.sql("ment") + " SELECT source_document_id, section_ordinal, mention_order, referenced_number AS raw_reference, referenced_number, referenced_label, cue_phrase, link_type, legal_type_hint, reference_year, 'high' AS confidence FROM ment")
def seg_section_mentions(spark, d):
    return graph(spark, d)[1][1].drop("reference_context")


@query(w.sql("ment") + " SELECT source_document_id, section_ordinal, mention_order, (legal_type_hint IS NOT NULL) AS runtime FROM ment")
def fn_needs_runtime(spark, d):
    found = graph(spark, d)[1][1]
    return found.select("source_document_id", "section_ordinal", "mention_order", runtime.needs_runtime(C("referenced_number"), C("legal_type_hint")).alias("runtime"))


@query(w.sql("ment") + " SELECT source_document_id AS id, referenced_number AS number, legal_type_hint AS hint FROM ment WHERE section_ordinal = 1 AND cue_phrase = 'can cu'")
def seg_mentions_ref(spark, d):
    found = laws(spark, d).where("id >= 7").select("id", F.explode(legal.references(text.ascii_fold(C("c0")))).alias("m"))
    return found.select("id", C("m.number").alias("number"), C("m.hint").alias("hint"))


@query(w.sql("ment") + " SELECT source_document_id AS id, referenced_number AS number FROM ment WHERE section_ordinal = 1 AND cue_phrase = 'can cu' AND legal_type_hint IS NULL")
def seg_numbers(spark, d):
    found = laws(spark, d).where("id >= 7").select("id", F.explode(legal.references(text.ascii_fold(C("c0")))).alias("m"))
    return found.where("m.hint IS NULL").select("id", C("m.number").alias("number"))


@query(w.sql("ment") + " SELECT source_document_id AS source_id, link_type AS relation_type, referenced_number AS number, coalesce(legal_type_hint, '') AS hint FROM ment WHERE section_ordinal = 0")
def seg_relation_cands(spark, d):
    return resolve.relation_candidates(laws(spark, d))


@query(w.sql("rels") + " SELECT * FROM rels")
def graph_relations(spark, d):
    return resolve.relation_graph(laws(spark, d)).select("source_document_id", "target_document_id", "relation_type")


@query(w.sql("rels") + ", c AS (SELECT count(*) AS n FROM rels) SELECT n FROM c")
def ing_rebuild_rel(spark, d):
    return resolve.relation_graph(laws(spark, d)).agg(F.count("*").alias("n"))


CITED = ["source_document_id", "section_ordinal", "mention_order", "target_document_id", "target_section_ordinal", "link_type"]
CITED_SQL = "source_document_id, section_ordinal, mention_order, target AS target_document_id, target_section_ordinal, link_type"


@query(w.sql("cites") + f" SELECT {CITED_SQL} FROM cites")
def graph_citations(spark, d):
    return graph(spark, d)[1][2].select(*CITED)


@query(w.sql("cites") + " SELECT link_type, count(*) AS n FROM cites GROUP BY ALL")
def ing_rebuild_cit(spark, d):
    return graph(spark, d)[1][2].groupBy("link_type").agg(F.count("*").alias("n"))


@query(w.sql("cites") + " SELECT DISTINCT source_document_id, target AS target_id FROM cites WHERE legal_type_hint IS NULL")
def er_choose(spark, d):
    """Numbers alone, as titles, preambles and articles name them."""
    found = graph(spark, d)[1]
    return found[2].join(found[1].where("legal_type_hint is null"), runtime.MENTION).select("source_document_id", C("target_document_id").alias("target_id")).distinct()


def asks(rows: DataFrame, target: Column, number: Column, context: Column) -> DataFrame:
    return rows.select(C("id").alias("ask"), C("id").alias("source_id"), number.alias("number"), F.lit(None).cast("string").alias("hint"), F.lit(None).cast("int").alias("year"), context.alias("context"))


@query(w.sql("laws") + " SELECT s.id AS ask, t.id AS target_id FROM laws s JOIN laws t ON t.id = s.id + 1 WHERE t.id % 4 <> 2")
def er_resolve_sql(spark, d):
    """Every law asks for the next one by its number as it stands."""
    rows = laws(spark, d)
    after = rows.select((C("id") - 1).alias("id"), C("document_number").alias("wanted"))
    both = rows.select("id").join(after, "id")
    return resolve.resolve(asks(both, C("id"), C("wanted"), F.lit("")), rows)


@query(w.sql("laws") + " SELECT s.id AS ask, (s.issuing_authority = t.issuing_authority) AS valid FROM laws s JOIN laws t ON t.id = s.id + 4 WHERE s.id % 4 = 2")
def flt_valid_context(spark, d):
    """A number of a local body means a document of the same body alone."""
    rows = laws(spark, d)
    after = rows.where("id % 4 = 2").select((C("id") - 4).alias("id"), C("document_number").alias("wanted"))
    both = rows.where("id % 4 = 2").select("id").join(after, "id")
    found = resolve.resolve(asks(both, C("id"), C("wanted"), F.lit("")), rows)
    return both.select(C("id").alias("ask")).join(found, "ask", "left").select("ask", C("target_id").isNotNull().alias("valid"))


@query(w.sql("secs") + ", l AS (SELECT id, unnest(['Điều 3', 'Khoản 2 Điều 1', 'Chương II', 'Phần X']) AS wanted, unnest(['Điều 3.', 'Điều 1.', 'Chương II QUY ĐỊNH CHUNG', NULL]) AS found, generate_subscripts([1, 2, 3, 4], 1) AS mention_order FROM laws) SELECT id AS target_document_id, CAST(mention_order AS INTEGER) AS mention_order, ordinal AS target_section_ordinal FROM l LEFT JOIN secs ON document_id = id AND label = found")
def graph_target_section(spark, d):
    rows = laws(spark, d)
    wanted = F.array(*map(F.lit, ("Điều 3", "Khoản 2 Điều 1", "Chương II", "Phần X")))
    links = rows.select(F.lit(-1).alias("source_document_id"), C("id").alias("section_ordinal"), C("id").alias("target_document_id"), F.posexplode(wanted).alias("k", "referenced_label")).withColumn("mention_order", C("k") + 1)
    return resolve.target_sections(links, segment.sections(rows)).select("target_document_id", "mention_order", "target_section_ordinal")


@query(w.sql("cites", "secs") + " SELECT source_document_id, section_ordinal, mention_order, coalesce(k.ordinal, c.target_section_ordinal) AS target_section_ordinal FROM cites c LEFT JOIN secs k ON k.document_id = c.target AND k.ordinal = 0 AND c.mention_order = 1")
def graph_target_section2(spark, d):
    """A section that is stored with the link comes first, else the label is looked for: here the first mention of each place has the title stored."""
    parts, _, links = graph(spark, d)[1]
    stored = links.withColumn("stored", F.when(C("mention_order") == 1, F.lit(0)))
    return resolve.stored_or_found(stored, parts).select("source_document_id", "section_ordinal", "mention_order", "target_section_ordinal")


GROUPED = """g AS (SELECT {here} AS document_id, link_type, {there} AS linked_id, count(*) AS mentions FROM c0 GROUP BY ALL)
SELECT document_id, link_type, linked_id, mentions, CAST(row_number() OVER (PARTITION BY document_id, link_type ORDER BY mentions DESC, issuance_date, title, linked_id) AS INTEGER) AS item FROM g JOIN laws ON id = linked_id"""
VIEW_COLUMNS = ["document_id", "link_type", "linked_id", "mentions", "item"]


def cited_links(found: DataFrame) -> DataFrame:
    return found.select(C("source_document_id").alias("source_id"), C("target_document_id").alias("target_id"), "link_type", C("section_ordinal").alias("section"))


@query(w.sql("cites") + ", c0 AS (SELECT source_document_id AS s, target AS t, link_type FROM cites), " + GROUPED.format(here="s", there="t"))
def graph_cit_view(spark, d):
    rows, found = graph(spark, d)
    return catalog.grouped_links(cited_links(found[2]), rows, legal.CITATION_ORDER).select(*VIEW_COLUMNS)


@query(w.sql("cites") + ", c0 AS (SELECT source_document_id AS s, target AS t, link_type FROM cites), " + GROUPED.format(here="t", there="s"))
def api_citations(spark, d):
    rows, found = graph(spark, d)
    return catalog.grouped_links(cited_links(found[2]), rows, legal.CITATION_ORDER, outgoing=False).select(*VIEW_COLUMNS)


def related_links(found: DataFrame) -> DataFrame:
    return found.select(C("source_document_id").alias("source_id"), C("target_document_id").alias("target_id"), C("relation_type").alias("link_type"), F.lit(0).alias("section"))


@query(w.sql("rels") + ", c0 AS (SELECT source_document_id AS s, target_document_id AS t, relation_type AS link_type FROM rels), " + GROUPED.format(here="s", there="t"))
def graph_rel_view(spark, d):
    rows = laws(spark, d)
    return catalog.grouped_links(related_links(resolve.relation_graph(rows)), rows, legal.RELATION_ORDER).select(*VIEW_COLUMNS)


@query(w.sql("rels") + ", c0 AS (SELECT source_document_id AS s, target_document_id AS t, relation_type AS link_type FROM rels), " + GROUPED.format(here="t", there="s"))
def api_relations(spark, d):
    rows = laws(spark, d)
    return catalog.grouped_links(related_links(resolve.relation_graph(rows)), rows, legal.RELATION_ORDER, outgoing=False).select(*VIEW_COLUMNS)


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    rows = b.stored(laws(spark, d), "laws")
    return rows, resolve.citation_graph(rows, b.stored)


@query(w.sql("cites") + " SELECT DISTINCT source_document_id AS document_id, referenced_number AS number, target AS target_id FROM cites WHERE legal_type_hint IS NOT NULL")
def graph_runtime(spark, d):
    rows, (parts, found, _) = graph(spark, d)
    return runtime.runtime_support(rows, parts, found)[0]


@query(w.sql("cites", "secs") + " SELECT source_document_id AS document_id, anchor, count(*) AS links FROM cites JOIN secs ON document_id = source_document_id AND ordinal = section_ordinal WHERE legal_type_hint IS NOT NULL GROUP BY ALL")
def graph_runtime_counts(spark, d):
    rows, (parts, found, _) = graph(spark, d)
    return runtime.runtime_support(rows, parts, found)[1]


@query(w.sql("cites") + ", e AS (SELECT DISTINCT source_document_id AS document_id, target AS linked FROM cites UNION SELECT DISTINCT target, source_document_id FROM cites) SELECT document_id, lower(strip_accents(document_number)) AS number, linked AS target_id FROM e JOIN laws ON id = linked")
def graph_citation_map(spark, d):
    rows, (_, _, links) = graph(spark, d)
    ways = [catalog.grouped_links(cited_links(links), rows, legal.CITATION_ORDER, outgoing=out).withColumn("direction", F.lit(k)) for k, out in enumerate((True, False))]
    return runtime.citation_map(ways[0].unionByName(ways[1]), rows)


ASK = "SELECT DISTINCT source_document_id, target_document_id FROM cited"
SCORED = """scored AS (SELECT c.*, s.anchor, CASE WHEN s.anchor = 'mở-đầu-1' THEN 4 ELSE 0 END + CASE WHEN c.referenced_number = n.wanted THEN 5 ELSE 0 END + CASE WHEN c.referenced_label IS NOT NULL THEN 1 ELSE 0 END AS points
FROM cites c JOIN secs s ON s.document_id = c.source_document_id AND s.ordinal = c.section_ordinal JOIN (SELECT id, """ + w.plain_number("id") + """ AS wanted FROM laws) n ON n.id = c.target),
best AS (SELECT *, row_number() OVER (PARTITION BY source_document_id, target ORDER BY points DESC, section_ordinal, mention_order) AS r FROM scored)"""


def preview_asks(rows: DataFrame, links: DataFrame) -> DataFrame:
    pair = links.select("source_document_id", "target_document_id").distinct()
    named = rows.select(C("id").alias("target_document_id"), legal.normalize_number(C("document_number")).alias("ask_raw"))
    return pair.join(named, "target_document_id").withColumn("ask_anchor", F.lit("mở-đầu-1"))


@query(w.sql("cites", "secs") + ", " + SCORED + " SELECT source_document_id, target AS target_document_id, CAST(points AS INTEGER) AS points, section_ordinal, mention_order, anchor, referenced_number FROM best WHERE r = 1")
def best_mention_row(spark, d):
    rows, (parts, found, links) = graph(spark, d)
    told = links.drop("link_type").join(found, runtime.MENTION).join(parts.select(C("document_id").alias("source_document_id"), C("ordinal").alias("section_ordinal"), "anchor"), ["source_document_id", "section_ordinal"])
    return runtime.best_mentions(told, preview_asks(rows, links)).drop("raw_reference", "referenced_label")


@query(w.sql("cites", "secs") + ", " + SCORED + """ SELECT b.source_document_id, b.target AS target_document_id, s.label AS source_label, b.referenced_number, b.referenced_label, b.link_type, CASE b.link_type WHEN 'amends' THEN 'Amends' ELSE 'Legal basis' END AS link_label, t.title AS target_title, t.document_number AS target_number, k.label AS target_label
FROM best b JOIN secs s ON s.document_id = b.source_document_id AND s.ordinal = b.section_ordinal JOIN laws t ON t.id = b.target LEFT JOIN secs k ON k.document_id = b.target AND k.ordinal = b.target_section_ordinal WHERE r = 1""")
def graph_preview(spark, d):
    rows, found = graph(spark, d)
    keep = ["source_document_id", "target_document_id", "source_label", "referenced_number", "referenced_label", "link_type", "link_label", "target_title", "target_number", "target_label"]
    return runtime.previews(found, rows, preview_asks(rows, found[2])).select(*keep)


@query(w.sql("cites") + ", r AS (SELECT target AS target_document_id, source_document_id, section_ordinal, link_type, row_number() OVER (PARTITION BY target ORDER BY s.year DESC, s.title, s.id, section_ordinal, mention_order) AS place FROM cites JOIN laws s ON s.id = source_document_id) SELECT target_document_id, CAST(place AS INTEGER) AS place, source_document_id, section_ordinal, link_type FROM r WHERE place <= 3")
def preview_incoming(spark, d):
    rows, (_, _, links) = graph(spark, d)
    return runtime.incoming(links, rows)


@query(w.sql("cites", "rels") + """ SELECT target_document_id AS document_id, 'updated-by' AS kind, 'amends' AS link_type, count(*) AS n FROM rels GROUP BY 1 UNION ALL SELECT source_document_id, 'changes-older', 'amends', count(*) FROM rels GROUP BY 1
UNION ALL SELECT target, 'mentioned-by', min(link_type), count(*) FROM cites GROUP BY 1""")
def preview_signals(spark, d):
    rows, (_, _, links) = graph(spark, d)
    return runtime.signals(resolve.relation_graph(rows), links)


# -- passages, clauses, profiles -------------------------------------------------------------------


def markdown(c: str) -> str:
    from .catalog_queries import _markdown

    return _markdown(c)


@query(
    w.sql("laws")
    + f""", t AS (SELECT id, {markdown('c1')} AS x FROM laws) SELECT id AS document_id, CAST(1 AS INTEGER) AS ordinal, 'Mở đầu' AS heading, c0 AS text FROM laws WHERE id >= 7
UNION ALL SELECT id, CASE WHEN id >= 7 THEN 2 ELSE 1 END, 'Điều 1.', regexp_replace(x, '\\n+', chr(10), 'g') FROM t
UNION ALL SELECT id, CASE WHEN id >= 7 THEN 3 ELSE 2 END, 'Điều 2.', concat(c2, chr(10), 'Chương II QUY ĐỊNH CHUNG') FROM laws WHERE id >= 4
UNION ALL SELECT id, CASE WHEN id >= 7 THEN 4 WHEN id >= 4 THEN 3 ELSE 2 END, 'Điều 3.', 'Điều 3. Hiệu lực' FROM laws"""
)
def seg_passages(spark, d):
    """Passages as long as their heading's text; the first laws have their chapter behind the first article."""
    return segment.passages(laws(spark, d).withColumn("content", F.when(C("id") >= 4, C("content")).otherwise(F.concat("c1", F.lit("\nĐiều 3. Hiệu lực")))), most=1 << 30)
