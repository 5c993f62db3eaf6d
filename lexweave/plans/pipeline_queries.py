"""Queries of sources, selections, ingestion, comparison, saved views and answers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import answer, catalog, compare, resolve, search, segment, selection, views
from ..schemas import DOCUMENT_SUBJECTS, DOCUMENTS, LINKS, METADATA, RELATIONS, SUBJECTS, struct
from ..sources import corpus, remote
from ..sources.corpus import VersionedTable
from ..streaming import ingest
from . import bridge as b
from . import laws as w
from .bridge import shared, stored
from .catalog_queries import DOC_BM25, PASSAGE_SQL, W, YEARS, _norm, query
from .corpus_queries import NEW_DATE, NEW_YEAR, fold, graph, laws, listed, plain

C = F.col


# -- raw sources -----------------------------------------------------------------------------------

RAW_META = """SELECT doc_id AS id, concat('Nghị định về ', CASE doc_id % 4 WHEN 0 THEN 'thuế' WHEN 1 THEN 'hôn nhân' WHEN 2 THEN 'hải quan' ELSE 'ngân hàng' END) AS title, concat(lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), '/', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '/', CAST(1990 + doc_id % 30 AS STRING)) AS ngay_ban_hanh,
 concat(CAST(doc_id AS STRING), '/X') AS so_ky_hieu, CASE WHEN doc_id % 7 = 0 THEN 'Luật' ELSE 'Nghị định' END AS loai_van_ban, CASE WHEN doc_id % 3 = 0 THEN 'Bộ Tài chính' ELSE 'Bộ Công an' END AS co_quan_ban_hanh, CASE WHEN doc_id % 2 = 0 THEN 'Thuế' END AS nganh, lang AS linh_vuc, source AS nguon_thu_thap, CAST(NULL AS STRING) AS chuc_danh, 'ký' AS nguoi_ky FROM {documents}"""
META_SQL = "meta AS (" + RAW_META.format(documents="documents") + ")"
CONTENT_SQL = "cont AS (SELECT page_id AS id, html AS content_html FROM pages UNION ALL SELECT page_id, substr(html, 1, 50) FROM pages UNION ALL SELECT page_id + 100000, '' FROM pages)"


def metadata(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RAW_META, documents=b.table(spark, d, "documents"))


def content(spark: SparkSession, d: str) -> DataFrame:
    """Every page whole and cut, and empty ones."""
    pages = b.table(spark, d, "pages")
    whole = pages.select(C("page_id").alias("id"), C("html").alias("content_html"))
    return whole.unionAll(pages.select("page_id", F.substring("html", 1, 50))).unionAll(pages.select(C("page_id") + 100000, F.lit("")))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def src_parquet_batches(spark, d):
    return corpus.read_batches(spark, f"{d}/documents.parquet", "doc_id long, text string, lang string", ["doc_id", "lang"], 20, 50, "doc_id")


@query("SELECT page_id AS id, html AS content_html FROM pages")
def src_content_cache(spark, d):
    return corpus.longest_content(content(spark, d))


@query("SELECT page_id AS id, length(html) AS n FROM pages WHERE page_id IN (SELECT doc_id FROM labels)")
def src_content_lookup(spark, d):
    ids = b.table(spark, d, "labels").select(C("doc_id").alias("id"))
    return corpus.content_of(content(spark, d), ids).select("id", F.length("content_html").alias("n"))


JOINED = "WITH " + META_SQL + " SELECT id, so_ky_hieu AS document_number, title, concat_ws(' | ', nganh, linh_vuc) AS legal_sectors, ngay_ban_hanh AS issuance_date, CAST(right(ngay_ban_hanh, 4) AS INTEGER) AS year, nguoi_ky AS signers FROM meta WHERE id IN (SELECT page_id FROM pages)"
RECORD = ["id", "document_number", "title", "legal_sectors", "issuance_date", "year", "signers"]


@query(JOINED)
def src_joined_records(spark, d):
    return corpus.records(metadata(spark, d), content(spark, d), YEARS).select(*RECORD)


@query(JOINED)
def prj_record_parquet(spark, d):
    return corpus.records(metadata(spark, d), content(spark, d), YEARS).select(*RECORD)


@query("SELECT doc_id AS id, lang, n_chars FROM documents")
def src_zip_records(spark, d):
    rows = b.table(spark, d, "documents")
    return corpus.joined_strict(rows.select(C("doc_id").alias("id"), "lang"), rows.select(C("doc_id").alias("id"), "n_chars"))


@query("SELECT sha256(concat_ws(':', count(*), sum(doc_id), sum(n_chars))) AS revision, '' AS missing FROM documents")
def src_revision(spark, d):
    found = corpus.revision(lambda: b.table(spark, d, "documents"), "doc_id", "n_chars")
    return spark.createDataFrame([(found, corpus.revision(lambda: b.table(spark, d, "not_there"), "x"))], "revision string, missing string")


@query("SELECT n_nationkey AS id, concat('/data/cache/', replace(n_name, '/', '--'), '/content') AS path FROM nation")
def src_paths(spark, d):
    rows = b.table(spark, d, "nation").collect()  # 25 rows
    return spark.createDataFrame([(r.n_nationkey, corpus.content_cache("/data/", r.n_name)) for r in rows], "id int, path string")


@query("SELECT r_regionkey AS id, concat('/', lower(r_name), '/cache') AS path FROM region")
def src_paths2(spark, d):
    rows = b.table(spark, d, "region").collect()  # five rows
    return spark.createDataFrame([(r.r_regionkey, corpus.cache_folder(f"/{r.r_name.lower()}/")) for r in rows], "id int, path string")


SLUG = "regexp_replace(regexp_replace(lower(n_name), '[^0-9a-z\\s-]', '', 'g'), '[\\s-]+', '-', 'g')"


def seed_file(spark: SparkSession, d: str) -> str:
    path = shared(spark, "seed")
    b.table(spark, d, "nation").select(C("n_nationkey").cast("string").alias("id"), C("n_name").alias("name")).coalesce(1).write.json(path)
    return path


@query(f"SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, {SLUG} AS slug, 'seed' AS source, 'u' AS source_url FROM nation")
def src_taxonomy_seed(spark, d):
    rows = spark.read.schema("id string, name string").json(seed_file(spark, d))
    path = shared(spark, "seed-list")
    rows.agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value")).write.text(path)  # 25 subjects
    return corpus.seed_subjects(spark, path, "u")


def options(spark: SparkSession, d: str) -> DataFrame:
    """A page of selection lists for each region."""
    option = F.concat(F.lit('<option value="'), C("n_nationkey").cast("string"), F.lit('"> '), "n_name", F.lit(" </option>\n"))
    return b.table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit('<select><option value="-1">Tất cả</option>'), F.array_join(F.collect_list(option), ""), F.lit("</select>")).alias("html"))


@query(f"SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, {SLUG} AS slug FROM nation")
def src_taxonomy_html(spark, d):
    return selection.subjects_from_html(options(spark, d))


@query(f"SELECT 'live' AS asked, CAST(n_nationkey AS VARCHAR) AS id FROM nation UNION ALL SELECT 'none', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'broken', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1")
def src_taxonomy_pick(spark, d):
    seed = b.table(spark, d, "nation").where("n_regionkey = 1").select(C("n_nationkey").cast("string").alias("id"))
    live = lambda: selection.subjects_from_html(options(spark, d)).select("id")
    asked = {"live": live, "none": lambda: live().limit(0), "broken": lambda: b.table(spark, d, "not_there")}
    each = [corpus.subjects_or_seed(f, seed).select(F.lit(k).alias("asked"), "id") for k, f in asked.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT doc_id AS id, concat(doc_id, '/X') AS document_number, concat('Document ', doc_id) AS title, 'corpus' AS source, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 AS has_text FROM documents")
def prj_record_md(spark, d):
    rows = b.table(spark, d, "documents").select(C("doc_id").alias("id"), C("text").alias("content"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("title", "url", "legal_type", "legal_sectors", "issuing_authority", "issuance_date", "signers")]
    meta = rows.select("id", F.concat(C("id").cast("string"), F.lit("/X")).alias("document_number"), *blank)
    return corpus.markdown_records(meta, rows, YEARS).select("id", "document_number", "title", "source", (F.length("plain_content") > 0).alias("has_text"))


@query("SELECT doc_id AS id, concat(doc_id, '/QĐ-X') AS document_number, CASE WHEN doc_id % 2 = 0 THEN concat('Tên ', lang) ELSE 'ngắn' END AS title, 'QUYẾT ĐỊNH' AS legal_type, CASE WHEN doc_id % 3 = 0 THEN 'BỘ A' ELSE lang END AS issuing_authority, '05/02/2014' AS issuance_date, CAST(2014 AS INTEGER) AS year FROM documents")
def prj_record_raw(spark, d):
    rows = b.table(spark, d, "documents")
    head = F.when(C("doc_id") % 3 == 0, "BỘ A | CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM Độc lập - Tự do - Hạnh phúc").otherwise(C("lang"))
    dated = F.concat(F.lit("Số: "), C("doc_id").cast("string"), F.lit("/QĐ-X | Hà Nội, ngày 5 tháng 2 năm 2014"))
    rest = F.when(C("doc_id") % 2 == 0, F.concat(F.lit("về\nTên "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise("ngắn")
    raw = F.concat_ws("\n\n", head, dated, F.lit("---"), F.lit("Quyết định"), rest)
    return corpus.gazette_records(rows.select(C("doc_id").alias("id"), raw.alias("raw"))).select("id", "document_number", "title", "legal_type", "issuing_authority", "issuance_date", "year")


# -- selections ------------------------------------------------------------------------------------

HITS = lambda field, words: f"len(list_filter({listed(words)}, lambda k: contains(concat(' ', {field}, ' '), concat(' ', k, ' '))))"
SCORES_SQL = f"""f AS (SELECT id, {plain('title')} AS t, {plain('loai_van_ban')} AS k, {plain('co_quan_ban_hanh')} AS i, {plain("concat_ws(' | ', nganh, linh_vuc)")} AS s, ngay_ban_hanh FROM meta),
h AS (SELECT *, concat_ws(' | ', t, k, i, s) AS hay, list_contains({listed(selection.FOCUS_TYPES)}, k) AS typed FROM f),
n AS (SELECT *, {HITS('i', selection.PRIMARY_ISSUERS)} AS np, {HITS('i', selection.CONDITIONAL_ISSUERS)} AS nc, {HITS('i', selection.FILTERED_ISSUERS)} AS nf, {HITS('s', selection.EXCLUDED_SECTORS)} AS nb, {HITS('s', selection.FOCUS_SECTORS)} AS ns, {HITS('hay', selection.FOCUS_WORDS)} AS nw, {HITS('hay', selection.PUBLIC_WORDS)} AS nu FROM h),
v AS (SELECT *, (CASE WHEN np > 0 THEN 5 ELSE 0 END) + (CASE WHEN ns > 0 THEN least(4, ns + 1) ELSE 0 END) + least(6, nw * 2) + (CASE WHEN nc > 0 AND (ns > 0 OR nw > 0) THEN 2 ELSE 0 END) + (CASE WHEN typed AND (ns > 0 OR nw > 0) THEN 1 ELSE 0 END) AS inc,
 nu * 3 + (CASE WHEN nf > 0 THEN 4 ELSE 0 END) + least(6, nb * 2) AS exc FROM n),
acc AS (SELECT *, NOT ((nf > 0 AND inc < 6) OR (nb > 0 AND inc < 7)) AND ((np > 0 AND inc >= 5 AND inc + 1 >= exc) OR (nc > 0 AND inc >= 4 AND inc > exc) OR (ns > 0 AND nw > 0 AND inc >= exc) OR (inc >= 5 AND inc > exc)) AS ok FROM v)"""


@query("WITH " + META_SQL + ", " + SCORES_SQL + " SELECT id, CAST(inc AS INTEGER) AS include, CAST(exc AS INTEGER) AS exclude, ok AS accepted FROM acc")
def flt_focus_corpus(spark, d):
    s = selection.focus_scores(*[C(c) for c in ("title", "loai_van_ban", "co_quan_ban_hanh", "nganh", "linh_vuc")])
    return metadata(spark, d).select("id", s["include"].alias("include"), s["exclude"].alias("exclude"), s["accepted"].alias("accepted"))


@query("WITH " + META_SQL + ", " + SCORES_SQL + " SELECT id FROM acc WHERE ok AND id IN (SELECT page_id FROM pages)")
def sel_focused(spark, d):
    return selection.select_focused(metadata(spark, d), content(spark, d).where("content_html != ''").select("id").distinct())


ECONOMIC = f"len(list_filter({listed(selection.ECONOMY_WORDS)}, lambda k: contains({fold('concat_ws(' + chr(39) + ' | ' + chr(39) + ', title, loai_van_ban, co_quan_ban_hanh, coalesce(nganh, ' + chr(39) * 2 + '), linh_vuc)')}, k))) > 0"


@query("WITH " + META_SQL + f" SELECT id FROM meta WHERE id IN (SELECT page_id FROM pages) AND id NOT IN (SELECT doc_id FROM labels) AND NOT ({ECONOMIC}) ORDER BY CAST(right(ngay_ban_hanh, 4) AS INTEGER) DESC, concat(right(ngay_ban_hanh, 4), substr(ngay_ban_hanh, 4, 2), substr(ngay_ban_hanh, 1, 2)) DESC, id DESC LIMIT 15")
def sel_recent(spark, d):
    have = b.table(spark, d, "labels").select(C("doc_id").alias("id"))
    return selection.select_recent(metadata(spark, d), content(spark, d).where("content_html != ''").select("id").distinct(), have, 15)


@query("SELECT DISTINCT page_id AS id FROM pages")
def sel_ids(spark, d):
    return content(spark, d).where("content_html != ''").select("id").distinct()


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sel_existing(spark, d):
    return metadata(spark, d).select("id").join(b.table(spark, d, "labels").select(C("doc_id").alias("id")), "id", "left_anti")


@query("WITH " + META_SQL + " SELECT id, title FROM meta WHERE id IN (SELECT doc_id FROM labels)")
def sel_lookup(spark, d):
    ids = b.table(spark, d, "labels").select(C("doc_id").alias("id"))
    rows = metadata(spark, d)
    return corpus.metadata_of(rows, ids).select("id", "title")


@query("SELECT page_id AS id FROM pages")
def ing_sel_load(spark, d):
    path = shared(spark, "selection")
    corpus.save_selection(b.table(spark, d, "pages").select(C("page_id").alias("id")), path)
    return corpus.load_selection(spark, path)


@query("SELECT 2 * count(*) AS kept, 0 AS missing FROM pages")
def ing_sel_save(spark, d):
    path, ids = shared(spark, "selection"), b.table(spark, d, "pages").select(C("page_id").alias("id"))
    corpus.save_selection(ids, path)
    corpus.save_selection(ids.unionAll(ids), path)
    return corpus.load_selection(spark, path).agg(F.count("*").alias("kept")).withColumn("missing", F.lit(corpus.load_selection(spark, f"{path}-none").count()).cast("int"))


@query(f"SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'changed' WHEN doc_id % 5 = 0 THEN 'new' ELSE 'same' END AS state FROM documents")
def flt_unchanged(spark, d):
    base = b.table(spark, d, "documents").select(C("doc_id").alias("id"), *[F.concat(F.lit(c), C("lang")).alias(c) for c in corpus.HASHED if c != "id"])
    old = base.withColumn("source_hash", segment.source_hash(*corpus.HASHED)).select("id", "source_hash").where("id % 5 != 0 or id % 3 = 0")
    new = base.withColumn("title", F.when(C("id") % 3 == 0, F.lit("other")).otherwise(C("title")))
    fresh = corpus.changed(new, old).select("id").withColumn("f", F.lit(1))
    known = old.select("id", F.lit(1).alias("k"))
    return new.select("id").join(fresh, "id", "left").join(known, "id", "left").select("id", F.when(C("f").isNull(), "same").when(C("k").isNull(), "new").otherwise("changed").alias("state"))


HASH_JSON = "concat('{\"content\":\"\",\"document_number\":\"', document_number, '\",\"id\":\"', id, '\",\"issuance_date\":\"', issuance_date, '\",\"issuing_authority\":\"', issuing_authority, '\",\"legal_sectors\":\"', legal_sectors, '\",\"legal_type\":\"', legal_type, '\",\"signers\":\"\",\"title\":\"', title, '\",\"url\":\"\"}')"


@query(w.sql("laws") + f" SELECT id, sha256({HASH_JSON}) AS hash FROM laws")
def fn_source_hash(spark, d):
    rows = laws(spark, d).withColumns({"url": F.lit(""), "signers": F.lit(None).cast("string"), "content": F.lit("")})
    return rows.select("id", segment.source_hash(*corpus.HASHED).alias("hash"))


# -- taxonomy --------------------------------------------------------------------------------------

SUBJECT_ROWS = (("a", "Tài chính"), ("b", "Lao động"), ("c", "Thuế"), ("d", "Đất đai"))
SUBJECT_SQL = "subj(id, name) AS (VALUES " + ", ".join(f"('{i}', '{n}')" for i, n in SUBJECT_ROWS) + ")"
LINK_SQL = "SELECT id AS document_id, unnest(CASE id % 3 WHEN 0 THEN ['a', 'c'] ELSE ['b'] END) AS subject_id FROM laws WHERE id % 3 < 2"


def four_subjects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SUBJECT_ROWS), "id string, name string")


@query(w.sql("laws") + " " + LINK_SQL)
def tax_classify(spark, d):
    return selection.subject_links(laws(spark, d), four_subjects(spark))


@query(w.sql("laws") + f", l AS ({LINK_SQL}) SELECT subject_id, count(*) AS documents FROM l GROUP BY 1")
def tax_links(spark, d):
    return selection.subject_links(laws(spark, d), four_subjects(spark)).groupBy("subject_id").agg(F.count("*").alias("documents"))


def taxonomy(spark: SparkSession) -> tuple[VersionedTable, VersionedTable, DataFrame]:
    seed = four_subjects(spark).select("id", "name", text.slugify(C("name")).alias("slug"), F.lit("seed").alias("source"), F.lit("").alias("source_url"))
    return VersionedTable(spark, shared(spark, "subjects"), SUBJECTS, ["id"], 4), VersionedTable(spark, shared(spark, "subject-links"), DOCUMENT_SUBJECTS, ["document_id", "subject_id"], 4), seed


@query(w.sql("laws") + " " + LINK_SQL)
def tax_bootstrap(spark, d):
    subjects, links, seed = taxonomy(spark)
    corpus.bootstrap_taxonomy(subjects, links, seed, laws(spark, d))
    return links.read()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS name FROM nation")
def tax_upsert(spark, d):
    table, _, _ = taxonomy(spark)
    rows = b.table(spark, d, "nation").select(C("n_nationkey").cast("string").alias("id"), C("n_name").alias("name"), text.slugify(C("n_name")).alias("slug"), F.lit("x").alias("source"), F.lit("").alias("source_url"), "n_regionkey")
    table.upsert(rows)
    table.upsert(rows.where("n_regionkey = 2").withColumn("name", F.lower("name")))
    return table.read().select("id", "name")


@query(f"SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE {SLUG} = 'saudi-arabia' OR n_name = 'NATION_7'")
def subject_by_slug(spark, d):
    rows = b.table(spark, d, "nation").select(C("n_nationkey").cast("string").alias("id"), C("n_name").alias("name")).withColumn("slug", text.slugify(C("name")))
    return catalog.by_slug(rows, "saudi-arabia").unionByName(catalog.by_slug(rows, "nation7")).select("id", "name")


# -- tables, upserts, ingestion --------------------------------------------------------------------


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS value FROM documents WHERE doc_id % 5 <> 0")
def sink_import_documents(spark, d):
    """Insert all documents, upsert a third of them (twice), then delete a fifth, in a versioned table."""
    t = VersionedTable(spark, shared(spark, "versioned"), "id long, value string", ["id"])
    docs = b.table(spark, d, "documents").select(C("doc_id").alias("id"), C("lang").alias("value"))
    t.upsert(docs)
    new = docs.where("id % 3 = 0").withColumn("value", F.upper("value"))
    t.upsert(new)
    t.upsert(new)
    t.delete(docs.where("id % 5 = 0"))
    return t.read()


def document_rows(rows: DataFrame) -> DataFrame:
    """Laws with the columns of the stored documents."""
    have = set(rows.columns)
    kinds = {f.name: f.dataType for f in struct(DOCUMENTS)}
    return rows.select(*[C(n).cast(t) if n in have else F.lit(None if n == "imported_at" else "").cast(t).alias(n) for n, t in kinds.items()])


STORED = DOCUMENTS + ", source_hash string"


def documents_table(spark: SparkSession) -> VersionedTable:
    return VersionedTable(spark, shared(spark, "documents"), STORED, ["id"], 8)


@query("SELECT 0 AS documents, 0 AS links, count(*) AS runs FROM region")
def sink_reset(spark, d):
    docs, _, _ = documents_table(spark), None, None
    _, links, _ = taxonomy(spark)
    ingest.import_batch(docs, document_rows(laws(spark, d)))
    links.replace(selection.subject_links(docs.read(), four_subjects(spark)))
    corpus.reset(docs, [links])
    return b.table(spark, d, "region").agg(F.count("*").alias("runs")).withColumns({"documents": F.lit(docs.read().count()).cast("int"), "links": F.lit(links.read().count()).cast("int")})


def counted(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([(name, *map(int, counts)) for name, counts in rows], "step string, scanned long, imported long, skipped long")


N = "(SELECT count(*) FROM documents)"


@query(f"SELECT 'first' AS step, {N} AS scanned, {N} AS imported, 0::BIGINT AS skipped UNION ALL SELECT 'again', {N}, 0, {N} UNION ALL SELECT 'changed', {N}, count(*) FILTER (doc_id % 4 = 0), count(*) FILTER (doc_id % 4 <> 0) FROM documents")
def ing_full_update(spark, d):
    docs, rows = documents_table(spark), document_rows(laws(spark, d))
    first, again = ingest.import_batch(docs, rows), ingest.import_batch(docs, rows)
    other = rows.withColumn("title", F.when(C("id") % 4 == 0, F.lit("anders")).otherwise(C("title")))
    return counted(spark, ("first", first), ("again", again), ("changed", ingest.import_batch(docs, other)))


@query("SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 70")
def ing_chunk(spark, d):
    docs, rows = documents_table(spark), document_rows(laws(spark, d))
    ingest.import_chunk(docs, rows, 0, 40)
    ingest.import_chunk(docs, rows, 40, 30)
    ingest.import_chunk(docs, rows, 40, 30)
    return docs.read().select("id")


FOCUSED_SQL = "WITH " + META_SQL + ", " + SCORES_SQL + ", chosen AS (SELECT id FROM acc WHERE ok AND id IN (SELECT page_id FROM pages))"


@query(FOCUSED_SQL + " SELECT id, 'first' AS run FROM chosen UNION ALL SELECT id, 'selection' FROM chosen")
def ing_focused_update(spark, d):
    docs, path = documents_table(spark), shared(spark, "selection")
    meta, html = metadata(spark, d), content(spark, d)
    ingest.focused_update(_plain(docs), meta, html, path, YEARS)
    ingest.focused_update(_plain(docs), meta, html, path, YEARS, reuse=True)
    return docs.read().select("id", F.lit("first").alias("run")).unionByName(corpus.load_selection(spark, path).select("id", F.lit("selection").alias("run")))


class _Padded(VersionedTable):
    """A documents table that takes records without the columns that imports fill in."""

    def upsert(self, rows: DataFrame) -> None:
        super().upsert(document_rows(rows).withColumn("source_hash", F.lit(None).cast("string")) if "source_hash" not in rows.columns else rows.withColumn("imported_at", F.lit(None).cast("timestamp")))


def _plain(table: VersionedTable) -> VersionedTable:
    return _Padded(table.spark, table.path, table.schema, table.key, table.buckets)


@query("SELECT id, 1 AS written FROM (SELECT page_id AS id FROM pages) WHERE id IN (SELECT doc_id FROM documents) AND id IN (SELECT doc_id FROM labels)")
def ing_selected(spark, d):
    docs = _plain(documents_table(spark))
    ids = b.table(spark, d, "labels").select(C("doc_id").alias("id"))
    ingest.import_selected(docs, metadata(spark, d), content(spark, d), ids, YEARS)
    return docs.read().select("id", F.lit(1).alias("written"))


@query("WITH " + META_SQL + f" SELECT id FROM meta WHERE id IN (SELECT page_id FROM pages) AND NOT ({ECONOMIC}) ORDER BY CAST(right(ngay_ban_hanh, 4) AS INTEGER) DESC, concat(right(ngay_ban_hanh, 4), substr(ngay_ban_hanh, 4, 2), substr(ngay_ban_hanh, 1, 2)) DESC, id DESC LIMIT 9")
def ing_recent_main(spark, d):
    docs = _plain(documents_table(spark))
    ingest.recent_update(docs, metadata(spark, d), content(spark, d), 9, YEARS)
    ingest.recent_update(docs, metadata(spark, d), content(spark, d), 9, YEARS)
    return docs.read().select("id")


def derived(spark: SparkSession) -> ingest.Derived:
    subjects, links, seed = taxonomy(spark)
    return ingest.Derived(subjects, links, VersionedTable(spark, shared(spark, "relations"), RELATIONS, ["source_document_id", "target_document_id", "relation_type"], 4), VersionedTable(spark, shared(spark, "links"), LINKS, ["source_document_id", "section_ordinal", "mention_order", "target_document_id"], 4), seed)


POST = w.sql("cites", "rels") + f", l AS ({LINK_SQL})"


@query(POST + " SELECT (SELECT count(*) FROM l) AS subjects, (SELECT count(*) FROM rels) AS relations, (SELECT count(*) FROM cites) AS citations, concat('monthly updater; relations=', (SELECT count(*) FROM rels), '; citations=', (SELECT count(*) FROM cites)) AS notes, 'monthly updater; postprocess=unchanged' AS again, 'failed' AS broken")
def ing_monthly(spark, d):
    """Two runs and a broken one: the first makes the derived tables, the second finds nothing new, the third is noted and raised."""
    docs, more = documents_table(spark), derived(spark)
    runs = ingest.runs_table(spark, shared(spark, "runs"))
    rows = document_rows(laws(spark, d))
    first = ingest.monthly(docs, runs, more, lambda: ingest.import_batch(docs, rows), "all")
    again = ingest.monthly(docs, runs, more, lambda: ingest.import_batch(docs, rows), "all")
    try:
        ingest.monthly(docs, runs, more, lambda: 1 // 0, "all")
    except ZeroDivisionError:
        pass
    broken = runs.read().where("event = 'failed' and notes like '%failed=%'").select("event").first()["event"]
    counts = [t.read().count() for t in (more.subject_links, more.relations, more.links)]
    return spark.createDataFrame([(*counts, first["notes"], again["notes"], broken)], "subjects long, relations long, citations long, notes string, again string, broken string")


@query(POST + " SELECT (SELECT count(*) FROM l) AS subjects, (SELECT count(*) FROM rels) AS relations, (SELECT count(*) FROM cites) AS citations, 0::BIGINT AS again")
def ing_startup(spark, d):
    docs, more = documents_table(spark), derived(spark)
    ingest.import_batch(docs, document_rows(laws(spark, d)))
    made = ingest.startup(docs, more)
    again = len(ingest.startup(docs, more))
    return spark.createDataFrame([(made["subjects"], made["relations"], made["citations"], again)], "subjects long, relations long, citations long, again long")


@query("SELECT 100::BIGINT AS documents, count(*) AS subjects, (SELECT count(*) FROM documents WHERE doc_id BETWEEN 5 AND 99 AND doc_id % 5 = 0) AS relations FROM (SELECT unnest(CASE doc_id % 3 WHEN 0 THEN ['a', 'c'] ELSE ['b'] END) FROM documents WHERE doc_id % 3 < 2 AND doc_id < 100)")
def ing_demo(spark, d):
    """A small corpus by the operator's own size."""
    docs, more = documents_table(spark), derived(spark)
    ingest.import_batch(docs, document_rows(laws(spark, d)))
    made = ingest.demo(docs, more, document_rows(laws(spark, d)), 100)
    return spark.createDataFrame([(docs.read().count(), made["subjects"], made["relations"])], "documents long, subjects long, relations long")


@query(POST + " SELECT count(*) AS subjects FROM l")
def ing_rebuild_tax(spark, d):
    return spark.createDataFrame([(ingest.rebuild_taxonomy(laws(spark, d), derived(spark)),)], "subjects long")


@query("SELECT 'x' AS dataset_name, 'all' AS selection_mode, count(*) AS imported_count, 'done' AS notes, true AS finished FROM documents")
def ing_run_finish(spark, d):
    runs = ingest.runs_table(spark, shared(spark, "runs"))
    n = b.table(spark, d, "documents").count()
    ingest.log_event(runs, "r", "start", dataset_name="x", selection_mode="all")
    ingest.log_event(runs, "r", "finish", imported_count=n, notes="done")
    return ingest.run_log(runs.read()).select("dataset_name", "selection_mode", "imported_count", "notes", C("finished_at").isNotNull().alias("finished"))


@query("SELECT 'x' AS dataset_name, 'rev' AS dataset_revision, 'start' AS event, false AS finished")
def ing_run_start(spark, d):
    runs = ingest.runs_table(spark, shared(spark, "runs"))
    ingest.log_event(runs, "r", "start", dataset_name="x", dataset_revision="rev")
    return runs.read().join(ingest.run_log(runs.read()).select("run_id", "finished_at"), "run_id").select("dataset_name", "dataset_revision", "event", C("finished_at").isNotNull().alias("finished"))


@query("SELECT 0 AS before, count(*) AS after FROM documents")
def is_empty(spark, d):
    docs = documents_table(spark)
    before = docs.read().count()
    docs.replace(document_rows(laws(spark, d)).withColumn("source_hash", F.lit("")))
    return docs.read().agg(F.count("*").alias("after")).withColumn("before", F.lit(before).cast("int"))


# -- row stores ------------------------------------------------------------------------------------


def picky_client():
    """A store in memory that refuses every tenth row, and every seventh the first time."""
    seen: set = set()

    def put(row: dict) -> None:
        if row["id"] % 10 == 0 or row["id"] % 7 == 0 and row["id"] not in seen:
            seen.add(row["id"])
            raise OSError("refused")

    return put


@query("SELECT count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 <> 0) AS written, count(*) FILTER (doc_id % 10 = 0 OR doc_id % 7 = 0) AS failed FROM documents")
def sink_rows_remote(spark, d):
    return remote.write_rows(b.table(spark, d, "documents").select(C("doc_id").alias("id"), "text"), picky_client)


@query("SELECT count(*) FILTER (doc_id % 10 <> 0) AS written, count(*) FILTER (doc_id % 10 = 0) AS failed FROM documents")
def sink_rows_remote3(spark, d):
    return remote.write_rows(b.table(spark, d, "documents").select(C("doc_id").alias("id"), "text"), picky_client, remote.TRIES)


@query(W("passages") + " SELECT count(*) FILTER (pid % 10 <> 0) AS written, count(*) FILTER (pid % 10 = 0) AS failed FROM passages")
def sink_rows_remote2(spark, d):
    return remote.write_rows(b.passages(spark, d).select(C("pid").alias("id"), "document_id", "ordinal", "heading", "text"), picky_client, remote.TRIES)


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'marks', count(*) FROM labels WHERE quality = 1 UNION ALL SELECT 'passages', count(*) FROM conversations")
def sink_migrate(spark, d):
    made = remote.migrate({"documents": b.docs(spark, d), "marks": b.marks(spark, d), "passages": b.passages(spark, d)}, shared(spark, "copy"))
    return spark.createDataFrame(list(made.items()), "name string, n long")


# -- comparison ------------------------------------------------------------------------------------


@query("SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(strip_accents(substr(text, 1, 500))), '[0-9a-z]+')) AS w FROM documents) a JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(strip_accents(substr(text, 1, 500))), '[0-9a-z]+')) AS w FROM documents) b ON b.doc_id = a.doc_id + 1")
def cmp_similarity(spark, d):
    docs = b.table(spark, d, "documents")
    left, right = docs.select(C("doc_id").alias("left_id"), C("text").alias("l")), docs.select(C("doc_id").alias("right_id"), C("text").alias("r"))
    pairs = left.join(right, C("right_id") == C("left_id") + 1)
    return pairs.select("left_id", "right_id", F.round(compare.jaccard(F.lit(""), C("l"), F.lit(""), C("r")), 6).alias("jaccard"))


PAIRS = w.sql("cites", "rels", "secs") + ", pairs AS (SELECT s.id AS left_id, t.id AS right_id FROM laws s JOIN laws t ON t.id = s.id - {gap})"


def pairs_of(rows: DataFrame, gap: int) -> DataFrame:
    return rows.select(C("id").alias("left_id"), (C("id") - gap).alias("right_id")).join(rows.select(C("id").alias("right_id")), "right_id").select("left_id", "right_id")


@query(PAIRS.format(gap=4) + " SELECT left_id, right_id, 'left_to_right' AS direction, section_ordinal, mention_order, link_type, referenced_label FROM pairs JOIN cites ON source_document_id = left_id AND target = right_id UNION ALL SELECT left_id, right_id, 'right_to_left', section_ordinal, mention_order, link_type, referenced_label FROM pairs JOIN cites ON source_document_id = right_id AND target = left_id")
def cmp_pair_links(spark, d):
    rows, (parts, found, links) = graph(spark, d)
    return compare.pair_links(pairs_of(rows, 4), links, found, parts).select("left_id", "right_id", "direction", "section_ordinal", "mention_order", "link_type", "referenced_label")


@query(PAIRS.format(gap=5) + " SELECT left_id, right_id, 'left_to_right' AS direction, relation_type, title AS evidence_text FROM pairs JOIN rels ON source_document_id = left_id AND target_document_id = right_id JOIN laws ON id = left_id")
def cmp_pair_rel(spark, d):
    rows = laws(spark, d)
    return compare.pair_relations(pairs_of(rows, 5), resolve.relation_graph(rows))


def view_of(spark: SparkSession, d: str, gap: int) -> tuple[DataFrame, DataFrame]:
    rows, (parts, found, links) = graph(spark, d)
    pairs = pairs_of(rows, gap)
    cited = stored(compare.pair_links(pairs, links, found, parts), "pair-links")
    return rows, stored(compare.view(pairs, parts, cited, stored(compare.pair_relations(pairs, resolve.relation_graph(rows)), "pair-relations"), stored).drop("left_text", "right_text"), "compared")


# documents that amend each other are matched by citations alone: of i and i - 4 the second article with the first
LIFE = PAIRS.format(gap=4) + ", v AS (SELECT left_id, right_id, unnest(CASE WHEN left_id >= 7 THEN ['left-only', 'matched', 'left-only', 'left-only', 'left-only'] ELSE ['left-only', 'matched', 'left-only', 'left-only', 'left-only'] END) AS kind, unnest(['điều-1-1', 'điều-2-1', 'chương-ii-quy-định-chung-1', 'điều-3-1', 'tieu-de']) AS left_anchor, unnest([NULL, 'điều-1-1', NULL, NULL, NULL]) AS right_anchor FROM pairs)"


@query(LIFE + " SELECT left_id, right_id, CASE WHEN left_anchor = 'điều-2-1' THEN 'matched' ELSE 'left-only' END AS kind, left_anchor, right_anchor, CASE WHEN left_anchor = 'điều-2-1' THEN 'amending instruction' END AS change FROM v")
def cmp_view(spark, d):
    rows = view_of(spark, d, 4)[1]
    return rows.where("kind != 'right-only'").select("left_id", "right_id", "kind", "left_anchor", "right_anchor", "change")


@query(PAIRS.format(gap=4) + " SELECT left_id, right_id, 1::BIGINT AS matched, 4::BIGINT AS left_only, CASE WHEN right_id >= 4 THEN 4 ELSE 3 END::BIGINT AS right_only, 1::BIGINT AS explicit, 0::BIGINT AS unchanged, 0::BIGINT AS expanded, 0::BIGINT AS reduced, 0::BIGINT AS rewritten, 1::BIGINT AS instruction FROM pairs")
def agg_compare_counts(spark, d):
    return compare.counts(view_of(spark, d, 4)[1])


@query(PAIRS.format(gap=4) + " SELECT left_id, right_id, CASE WHEN left_id % 3 = 0 THEN 'điều-3-1' ELSE 'điều-2-1' END AS left_anchor, CASE WHEN left_id % 3 = 0 THEN NULL ELSE 'điều-1-1' END AS right_anchor, CASE left_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier FROM pairs")
def cmp_focus(spark, d):
    rows, shown = view_of(spark, d, 4)
    asked = pairs_of(rows, 4).withColumn("left_ask", F.when(C("left_id") % 3 == 0, F.lit("điều-3-1"))).withColumn("right_ask", F.when(C("left_id") % 3 == 1, F.lit("điều-1-1")))
    return compare.focus(shown, asked).select("left_id", "right_id", "left_anchor", "right_anchor", "tier")


@query(PAIRS.format(gap=4) + " SELECT left_id, right_id, concat('/compare/', left_id, '/', right_id) AS compare_path, title AS right_title, document_number AS right_number, 'Điều 2.' AS left_label, 'Điều 1.' AS right_label, 'amending instruction' AS change FROM pairs JOIN laws ON id = right_id")
def cmp_preview(spark, d):
    rows, shown = view_of(spark, d, 4)
    none = F.lit(None).cast("string")
    asked = pairs_of(rows, 4).withColumns({"left_ask": none, "right_ask": none})
    return compare.preview(shown, asked, rows).select("left_id", "right_id", "compare_path", "right_title", "right_number", "left_label", "right_label", "change")


@query(PAIRS.format(gap=1) + " SELECT left_id, right_id, 'tieu-de' AS left_anchor, 'tieu-de' AS right_anchor FROM pairs WHERE left_id >= 8 UNION ALL SELECT left_id, right_id, unnest(['điều-1-1', 'điều-2-1', 'chương-ii-quy-định-chung-1', 'điều-3-1']), unnest(['điều-1-1', 'điều-2-1', 'chương-ii-quy-định-chung-1', 'điều-3-1']) FROM pairs WHERE left_id >= 8")
def cmp_align(spark, d):
    """Neighbours are of no lifecycle: equal labels match, and the titles are alike."""
    rows = laws(spark, d)
    pairs = pairs_of(rows, 1).where("left_id >= 8")
    return compare.align(pairs, segment.sections(rows), keep=stored).where("kind = 'matched'").select("left_id", "right_id", "left_anchor", "right_anchor")


# -- saved views and answers -----------------------------------------------------------------------

SAVED = "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'Mine' WHEN doc_id % 4 = 1 THEN 'Research: of the' WHEN doc_id % 4 = 2 THEN 'en watch' ELSE 'Topic watch: thue' END AS name, CASE WHEN doc_id % 4 = 1 THEN 'of the' ELSE '' END AS query FROM documents"


def saved(spark: SparkSession, d: str) -> DataFrame:
    """A view for every document of the first four nations, created through the operator."""
    rows = b.table(spark, d, "region").select(C("r_regionkey").alias("k"))
    new = rows.select(
        F.when(C("k") == 0, F.lit(" Mine ")).alias("name"), F.when(C("k") == 1, F.lit(" an ther ")).when(C("k") == 3, F.lit("tion")).alias("query"), F.when(C("k") == 3, F.lit("nation3")).alias("topic_slug"), F.when(C("k") == 2, F.lit("en")).alias("legal_type"),
        F.lit(None).cast("string").alias("issuer"), F.when(C("k") == 4, F.lit(2001)).alias("year"), F.make_timestamp(F.lit(2024), F.lit(1), C("k") + 1, F.lit(0), F.lit(0), F.lit(0)).alias("created_at"),
    )
    none = spark.createDataFrame([], "id long, name string, query string, topic_slug string, legal_type string, issuer string, year int, created_at timestamp, updated_at timestamp")
    return views.created(none, new)


VIEW_ROWS = "v(id, name, query, legal_type, year) AS (VALUES (1::BIGINT, 'Mine', '', NULL, NULL::INTEGER), (2, 'Research: an ther', 'an ther', NULL, NULL), (3, 'en watch', '', 'en', NULL), (4, 'Research: tion', 'tion', NULL, NULL), (5, 'Saved legal view', '', NULL, 2001))"


@query("WITH " + VIEW_ROWS + " SELECT v.* FROM v JOIN region ON r_regionkey = id - 1")
def views_create(spark, d):
    return saved(spark, d).select("id", "name", "query", "legal_type", "year")


@query("WITH " + VIEW_ROWS + " SELECT id, name FROM v JOIN region ON r_regionkey = id - 1 WHERE id = 3")
def views_get(spark, d):
    return views.get(saved(spark, d), 3).select("id", "name")


@query("WITH " + VIEW_ROWS + " SELECT id, name FROM v JOIN region ON r_regionkey = id - 1 WHERE id <> 3")
def views_delete(spark, d):
    return views.deleted(saved(spark, d), 3).select("id", "name")


@query(W("docs") + " SELECT id, title FROM docs WHERE legal_type = 'en' ORDER BY year DESC, issuance_date DESC, title, id LIMIT 12")
def api_view_detail(spark, d):
    docs = b.docs(spark, d)
    index = search.Index(docs.limit(0).select(F.lit("").alias("term"), "id", F.lit("").alias("column"), F.lit(0).alias("tf")), docs.limit(0).select("id", F.lit(0).alias("length")), "id", ("title",))
    subjects = b.subjects(spark, d).withColumn("slug", text.slugify(C("name")))
    return views.run(saved(spark, d), 3, docs, index, subjects, last_year=YEARS).select("id", "title")


@query(W("docs") + ", " + DOC_BM25 + " SELECT id, title, 'general' AS family, 'unknown' AS scope FROM docs JOIN scored USING (id) ORDER BY round(bm25, 6), year DESC, title, id LIMIT 12")
def api_search(spark, d):
    from ..functions.legal import provenance
    from .catalog_queries import DOC_QUERY

    docs = b.docs(spark, d)
    hits = search.search_documents(docs, search.build_index(docs, "id", list(search.DOCUMENT_WEIGHTS), stored), DOC_QUERY, last_year=YEARS)
    p = provenance(C("document_number"), C("title"), C("legal_type"), F.lit(None).cast("string"))
    return hits.select("id", "title", p["family"].alias("family"), p["scope"].alias("scope"))


def _bonus(c: str, phrase: float, word: float) -> str:
    return f"CASE WHEN contains({c}, 'thtion erin') THEN {phrase} ELSE 0 END + CASE WHEN contains({c}, 'thtion') THEN {word} ELSE 0 END + CASE WHEN contains({c}, 'erin') THEN {word} ELSE 0 END"


@query(
    PASSAGE_SQL
    + f""", top AS (SELECT p.document_id, ordinal, heading, text, title, issuance_date, bm25 FROM scored JOIN passages p USING (pid) JOIN docs ON document_id = id WHERE document_id = 3 ORDER BY bm25, p.document_id, ordinal LIMIT 72),
s AS (SELECT *, round(-bm25 + {_bonus(_norm('title'), 14.0, 3.0)} + {_bonus(_norm('heading'), 10.0, 2.0)} + {_bonus(_norm('text'), 8.0, 1.0)}, 6) AS score FROM top),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id, ordinal) AS place FROM (SELECT * FROM s ORDER BY score DESC, issuance_date DESC, ordinal DESC, document_id LIMIT 6)),
p2 AS (SELECT place, unnest(string_split(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(31), 'g'), chr(31))) AS text FROM best), c AS (SELECT place, trim(text) AS text FROM p2 WHERE length(trim(text)) >= 60),
k AS (SELECT *, CASE WHEN contains(lower(text), 'erin') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'thtion') THEN 1 ELSE 0 END AS o, len(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')) AS n FROM c)
SELECT text, round(max(o + o / n), 6) AS score FROM k GROUP BY text ORDER BY 2 DESC, min(place), text LIMIT 3"""
)
def api_ask(spark, d):
    """A question to one document: its best passages, and the best sentences in them."""
    pieces, docs = b.passages(spark, d), b.docs(spark, d)
    index = search.build_index(pieces, "pid", list(search.PASSAGE_WEIGHTS))
    return answer.ask(pieces, index, docs, index, "thtion erin", document_id=3)[0].select("text", "score")


@query()
def api_ask_corpus(spark, d):
    """A question to the whole corpus: (kind, text or document)."""
    pieces, docs = b.passages(spark, d), b.docs(spark, d)
    found, origin = answer.ask(pieces, search.build_index(pieces, "pid", list(search.PASSAGE_WEIGHTS), stored), docs, search.build_index(docs, "id", list(search.DOCUMENT_WEIGHTS), stored), "the of")
    return found.select(F.lit("finding").alias("kind"), "text").unionByName(origin.select(F.lit("source").alias("kind"), C("document_id").cast("string").alias("text")))


# -- composed views --------------------------------------------------------------------------------


@query(w.sql("cites", "rels", "secs") + """, n AS (SELECT document_id, count(*) AS headings FROM secs WHERE section_type IN ('article', 'chapter') GROUP BY 1), c AS (SELECT source_document_id AS document_id, count(*) AS links FROM cites GROUP BY 1), i AS (SELECT target AS document_id, count(*) AS mentions FROM cites GROUP BY 1), r AS (SELECT target_document_id AS document_id, count(*) AS updates FROM rels GROUP BY 1)
SELECT id AS document_id, headings, coalesce(links, 0) AS links, coalesce(mentions, 0) AS mentions, coalesce(updates, 0) AS updates, 'normative' AS family FROM laws JOIN n ON n.document_id = id LEFT JOIN c ON c.document_id = id LEFT JOIN i ON i.document_id = id LEFT JOIN r ON r.document_id = id""")
def api_document(spark, d):
    """What a reader is told of every document: its outline, citations out and in, what changed it, and its family."""
    from ..functions.legal import provenance
    from ..operators.display import outline

    rows, (parts, _, links) = graph(spark, d)
    relations = resolve.relation_graph(rows)
    per = lambda df, c, name: df.groupBy(C(c).alias("document_id")).agg(F.count("*").alias(name))
    p = provenance(C("document_number"), C("title"), C("legal_type"), C("issuing_authority"))
    out = rows.select(C("id").alias("document_id"), p["family"].alias("family"))
    for df, c, name in ((outline(parts), "document_id", "headings"), (links, "source_document_id", "links"), (links, "target_document_id", "mentions"), (relations, "target_document_id", "updates")):
        out = out.join(per(df, c, name), "document_id", "left")
    return out.na.fill(0, ["headings", "links", "mentions", "updates"])


@query(W("docs", "marks", "links", "subjects") + f" SELECT (SELECT count(*) FROM docs) AS document_count, (SELECT count(DISTINCT issuing_authority) FROM docs WHERE issuing_authority <> '') AS authority_count, (SELECT count(*) FROM marks) AS tracked_count, (SELECT count(*) FROM subjects) AS taxonomy_subject_count, (SELECT count(*) FROM links WHERE link_type <> 'cites') AS relation_count, (SELECT count(*) FROM links) AS citation_link_count, 5::BIGINT AS research_view_count, (SELECT min(year) FROM docs WHERE year BETWEEN 1800 AND {YEARS}) AS min_year, (SELECT max(year) FROM docs WHERE year BETWEEN 1800 AND {YEARS}) AS max_year, make_timestamp(2024, 5, 1, 0, 0, 0.0) AS last_imported_at")
def agg_stats_full(spark, d):
    links = b.links(spark, d)
    docs = b.docs(spark, d).withColumn("imported_at", F.make_timestamp(F.lit(2024), F.lit(5), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return catalog.full_stats(docs, YEARS, b.marks(spark, d), b.subjects(spark, d), links.where("link_type != 'cites'"), links, saved(spark, d))


@query(W("docs", "marks") + ", have AS (SELECT document_id FROM marks UNION SELECT 3) SELECT count(*) AS tracked_count, bool_or(document_id = 3) AS tracked FROM have")
def api_track(spark, d):
    marks = catalog.set_tracking(b.marks(spark, d), b.docs(spark, d), 3, True, F.to_timestamp(F.lit("2024-02-01")))
    return marks.agg(F.count("*").alias("tracked_count"), F.bool_or(C("document_id") == 3).alias("tracked"))


@query("SELECT name, type FROM (VALUES ('id', 'bigint'), ('title', 'string'), ('year', 'int'), ('content', 'string')) v(name, type)")
def ddl_schema(spark, d):
    rows = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in struct(DOCUMENTS)], "name string, type string")
    return rows.where("name in ('id', 'title', 'year', 'content')")


@query("SELECT name, kind, required FROM (VALUES ('id', 'integer', true), ('title', 'text', false), ('year', 'integer', false), ('document_id', 'integer', true)) v(name, kind, required)")
def sink_remote_ddl2(spark, d):
    rows = spark.createDataFrame([*remote.columns_of(struct(DOCUMENTS)), *remote.columns_of(struct(DOCUMENT_SUBJECTS))], "name string, kind string, required boolean")
    return rows.where("name in ('id', 'title', 'year', 'document_id')")
