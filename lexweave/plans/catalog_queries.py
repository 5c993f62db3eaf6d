"""Relational queries of the catalogue, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import legal, text
from ..operators import catalog, search, segment, views
from . import bridge as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SANE = f"CASE WHEN year BETWEEN 1800 AND {b.LAST_YEAR} THEN year END"
YEARS = b.LAST_YEAR
W = b.with_views

# -- lookups, lists, pages -------------------------------------------------------------------------


@query(W("docs") + " SELECT id, title, document_number FROM docs WHERE id = 17")
def get_document(spark, d):
    return b.docs(spark, d).where("id = 17").select("id", "title", "document_number")


@query(W("docs") + ", ids AS (SELECT * FROM (VALUES (40, 0), (7, 1), (99, 2)) v(id, position)) SELECT position, docs.id, title FROM docs JOIN ids USING (id)")
def get_documents_by_ids(spark, d):
    return catalog.by_ids(b.docs(spark, d), [40, 7, 99]).select("position", "id", "title")


@query(W("docs") + f" SELECT id, year, issuance_date FROM docs ORDER BY {SANE} DESC NULLS LAST, CASE WHEN year BETWEEN 1800 AND {YEARS} THEN issuance_date END DESC NULLS LAST, id DESC LIMIT 5")
def recent_documents(spark, d):
    return catalog.recent(b.docs(spark, d), YEARS).select("id", "year", "issuance_date")


@query(W("docs", "marks") + " SELECT id, title FROM docs JOIN marks ON id = document_id ORDER BY tracked_at DESC, id DESC LIMIT 8")
def tracked_documents(spark, d):
    return catalog.tracked(b.docs(spark, d), b.marks(spark, d)).select("id", "title")


@query(W("marks") + " SELECT document_id FROM marks WHERE document_id IN (SELECT doc_id FROM documents)")
def tracked_ids(spark, d):
    wanted = b.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return b.marks(spark, d).join(wanted, "document_id", "left_semi").select("document_id")


@query(W("docs", "marks") + " SELECT document_id FROM marks UNION SELECT id FROM docs WHERE id = 3 EXCEPT SELECT 5")
def tracked_set(spark, d):
    docs, now = b.docs(spark, d), F.to_timestamp(F.lit("2024-02-01"))
    return catalog.set_tracking(catalog.set_tracking(b.marks(spark, d), docs, 3, True, now), docs, 5, False, now).select("document_id")


@query(W("docs") + " SELECT id, year, title FROM docs WHERE legal_type = 'en' AND contains(lower(issuing_authority), 'src1') ORDER BY year DESC, issuance_date DESC, title, id LIMIT 12 OFFSET 12")
def list_all_docs(spark, d):
    kept = search.facets(b.docs(spark, d), legal_type="en", issuer="SRC1")
    return search.page(kept, search.browse_order(), 2).select("id", "year", "title")


@query(W("docs") + " SELECT count(*) AS total, CAST(ceil(count(*) / 12.0) AS BIGINT) AS page_count FROM docs WHERE year = 2001")
def page_meta(spark, d):
    return search.page_meta(search.facets(b.docs(spark, d), year=2001))


@query(W("docs") + " SELECT id, issuing_authority FROM docs WHERE legal_type = 'fr' AND year = 2003 AND contains(lower(issuing_authority), 'src')")
def flt_facets(spark, d):
    return search.facets(b.docs(spark, d), "fr", 2003, "src").select("id", "issuing_authority")


@query("SELECT name, row_number() OVER (ORDER BY updated_at DESC, created_at DESC, id DESC) AS place FROM (SELECT user_id AS id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(event_type, (ts, event_id)) AS name FROM events GROUP BY user_id) WHERE name <> 'error' ORDER BY place LIMIT 12")
def views_list(spark, d):
    events = b.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"))
    first = events.groupBy("id").agg(F.min("updated_at").alias("created_at"))
    from pyspark.sql.window import Window

    order = [F.col("updated_at").desc(), F.col("created_at").desc(), F.col("id").desc()]
    top = views.listing(views.latest(events).join(first, "id"))
    return top.select("name", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # at most twelve rows


# -- joins -----------------------------------------------------------------------------------------


@query(W("links") + ", secs AS (SELECT o_orderkey AS document_id, k AS section_ordinal FROM orders CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)) SELECT document_id, CAST(section_ordinal AS INTEGER) AS section_ordinal, count(target_id) AS links FROM secs LEFT JOIN links ON document_id = source_id AND section_ordinal = section GROUP BY ALL")
def agg_section_citations(spark, d):
    sections = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("section_ordinal"))
    links = b.links(spark, d).select(F.col("source_id").alias("document_id"), F.col("section").alias("section_ordinal"), F.monotonically_increasing_id().alias("mention_order"), F.col("target_id").alias("target_document_id"))
    one = links.select("document_id", "section_ordinal").distinct().withColumn("mention_order", F.lit(1))
    return catalog.section_citation_counts(sections, one, links.withColumn("mention_order", F.lit(1)))


@query(W("subjects", "bridge") + " SELECT id, name, count(document_id) AS documents FROM subjects LEFT JOIN bridge ON id = subject_id GROUP BY ALL")
def agg_subject_counts(spark, d):
    return catalog.subject_counts(b.subjects(spark, d), b.bridge(spark, d))


@query(W("subjects", "bridge") + " SELECT document_id, name FROM bridge JOIN subjects ON subject_id = id")
def document_subjects(spark, d):
    return b.bridge(spark, d).join(b.subjects(spark, d), F.col("subject_id") == F.col("id")).select("document_id", "name")


@query(
    W("docs", "bridge")
    + """, f AS (SELECT document_id, subject_id, year, issuance_date, title FROM bridge JOIN docs ON document_id = id),
p AS (SELECT DISTINCT a.document_id, o.document_id AS other_id, o.year, o.issuance_date, o.title FROM f a JOIN f o ON a.subject_id = o.subject_id AND a.document_id <> o.document_id AND o.year >= a.year),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY year DESC, issuance_date DESC, title, other_id) AS place FROM p)
SELECT document_id, CAST(place AS INTEGER) AS place, other_id FROM r WHERE place <= 3"""
)
def same_subject_updates(spark, d):
    return catalog.same_subject(b.docs(spark, d), b.bridge(spark, d))


@query(W("links") + ", n AS (SELECT source_id AS a, target_id AS o FROM links UNION SELECT target_id, source_id FROM links) SELECT a AS document_id, count(*) AS neighbours FROM n WHERE a <> o GROUP BY a")
def join_edge_endpoint(spark, d):
    return catalog.neighbours(b.links(spark, d)).groupBy("document_id").agg(F.count("*").alias("neighbours"))


GROUPED = (
    W("links", "parts")
    + """, g AS (SELECT {here} AS document_id, link_type, {there} AS linked_id, count(*) AS mentions, string_agg(DISTINCT CAST(section AS VARCHAR), ',' ORDER BY CAST(section AS VARCHAR)) AS sections FROM links GROUP BY ALL)
SELECT document_id, link_type, CAST(list_position(['amends', 'replaces', 'guides', 'implements', 'basis_for', 'cites'], link_type) AS INTEGER) AS type_order, CAST(row_number() OVER (PARTITION BY document_id, link_type ORDER BY mentions DESC, issuance_date, title, linked_id) AS INTEGER) AS item, linked_id, mentions, sections
FROM g JOIN parts ON linked_id = parts.id"""
)


@query(GROUPED.format(here="source_id", there="target_id"))
def agg_citation_groups(spark, d):
    return catalog.grouped_links(b.links(spark, d), b.parts(spark, d), legal.CITATION_ORDER)


@query(GROUPED.format(here="target_id", there="source_id") + " WHERE link_type <> 'cites'")
def agg_relation_groups(spark, d):
    return catalog.grouped_links(b.links(spark, d).where("link_type != 'cites'"), b.parts(spark, d), legal.CITATION_ORDER, outgoing=False)


@query(
    W("links")
    + """, e AS (SELECT source_id, target_id, link_type FROM links), t AS (
SELECT target_id AS document_id, 1 AS tier, source_id AS other_id FROM e WHERE link_type IN ('replaces', 'amends') UNION ALL SELECT source_id, 2, target_id FROM e WHERE link_type IN ('replaces', 'amends')
UNION ALL SELECT target_id, 3, source_id FROM e WHERE link_type = 'cites' UNION ALL SELECT source_id, 4, target_id FROM e WHERE link_type = 'cites')
SELECT document_id, tier, min(other_id) AS other_id FROM (SELECT *, min(tier) OVER (PARTITION BY document_id) AS best FROM t WHERE document_id <> other_id) WHERE tier = best GROUP BY ALL"""
)
def compare_target(spark, d):
    links = b.links(spark, d)
    return catalog.compare_targets(links, links.where("link_type = 'cites'"))


@query(
    W("docs", "marks", "links", "bridge")
    + """, a AS (SELECT target_id AS document_id, CASE WHEN link_type IN ('amends', 'replaces') THEN 'high' ELSE 'medium' END AS severity, concat('lifecycle:', link_type) AS kind FROM links WHERE link_type <> 'cites'
UNION ALL SELECT target_id, 'medium', 'citation' FROM links WHERE link_type = 'cites'
UNION ALL SELECT document_id, 'low', 'topic' FROM (SELECT DISTINCT x.document_id, y.document_id AS o, dense_rank() OVER (PARTITION BY x.document_id ORDER BY dy.year DESC, dy.issuance_date DESC, dy.title, dy.id) AS k FROM bridge x JOIN docs dx ON x.document_id = dx.id JOIN bridge y ON x.subject_id = y.subject_id AND x.document_id <> y.document_id JOIN docs dy ON y.document_id = dy.id AND dy.year >= dx.year) WHERE k <= 3)
SELECT CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank, document_id, severity, kind, count(*) AS targets FROM a JOIN marks USING (document_id) GROUP BY ALL"""
)
def api_tracking(spark, d):
    links = b.links(spark, d)
    updates = catalog.same_subject(b.docs(spark, d), b.bridge(spark, d))
    return catalog.alerts(b.marks(spark, d), links.where("link_type != 'cites'"), links.where("link_type = 'cites'"), updates)


@query(
    W("docs", "links")
    + """, me AS (SELECT * FROM docs WHERE id = 10), n AS (SELECT target_id AS id, link_type FROM links WHERE source_id = 10 UNION SELECT source_id, link_type FROM links WHERE target_id = 10),
c AS (SELECT d.id, d.title, CASE WHEN n.link_type = 'cites' THEN 2 ELSE 1 END AS tier, 0 AS gap, d.year FROM docs d JOIN n ON d.id = n.id WHERE d.id <> 10
UNION ALL SELECT d.id, d.title, 3, abs(d.year - me.year), d.year FROM docs d JOIN me ON d.legal_type = me.legal_type OR d.issuing_authority = me.issuing_authority OR d.year = me.year WHERE d.id <> 10),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, gap) AS r FROM c)
SELECT id, title, tier FROM m WHERE r = 1 ORDER BY tier, gap, CASE WHEN tier < 3 THEN year END DESC NULLS LAST, title, id LIMIT 4"""
)
def related_documents(spark, d):
    links = b.links(spark, d)
    return catalog.related(b.docs(spark, d), links.where("link_type != 'cites'"), links.where("link_type = 'cites'"), 10)


# -- counts ----------------------------------------------------------------------------------------


@query(W("docs") + f" SELECT count(*) AS documents, count(DISTINCT CASE WHEN issuing_authority <> '' THEN issuing_authority END) AS issuers, min({SANE}) AS first_year, max({SANE}) AS last_year FROM docs")
def agg_stats(spark, d):
    return catalog.stats(b.docs(spark, d), YEARS)


@query(W("docs") + f" SELECT 'type' AS facet, legal_type AS value, n AS documents FROM (SELECT legal_type, count(*) AS n FROM docs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) UNION ALL SELECT 'year', CAST(y AS VARCHAR), NULL FROM (SELECT DISTINCT {SANE} AS y FROM docs WHERE {SANE} IS NOT NULL ORDER BY 1 DESC LIMIT 20)")
def agg_filter_options(spark, d):
    docs = b.docs(spark, d)
    kinds = catalog.top_types(docs, 12).select(F.lit("type").alias("facet"), F.col("legal_type").alias("value"), "documents")
    return kinds.unionByName(catalog.newest_years(docs, YEARS).select(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value"), F.lit(None).cast("long").alias("documents")))


@query(W("docs") + " SELECT legal_type, count(*) AS documents FROM docs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def agg_top_types(spark, d):
    return catalog.top_types(b.docs(spark, d))


@query(W("passages") + " SELECT heading, min(ordinal) AS ordinal FROM passages WHERE document_id = 3 GROUP BY 1 ORDER BY 2 LIMIT 40")
def agg_outline(spark, d):
    return catalog.outline(b.passages(spark, d), 3)


@query(W("links") + " SELECT (SELECT count(*) FROM links WHERE link_type <> 'cites') AS relations, (SELECT count(*) FROM links) AS citations, (SELECT count(*) FROM documents) AS documents")
def agg_counts(spark, d):
    docs = b.table(spark, d, "documents").agg(F.count("*").alias("documents"))
    return b.links(spark, d).agg(F.count(F.when(F.col("link_type") != "cites", 1)).alias("relations"), F.count("*").alias("citations")).join(docs)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    from ..streaming.ingest import event_counts

    return event_counts(b.table(spark, d, "events")).withColumn("total", F.round("total", 4))


# -- search ----------------------------------------------------------------------------------------

FOLDED = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(source: str, key: str, weights: dict[str, float], prefixes: list[str]) -> str:
    """CTEs that end in ``scored(key, bm25)``."""
    columns = list(weights)
    toks = ", ".join(f"{FOLDED.format(f'coalesce({c}, {chr(39) * 2})')} AS t_{c}" for c in columns)
    per = " UNION ALL ".join(f"SELECT {key}, len, {i} AS p, " + " + ".join(f"{w} * len(list_filter(t_{c}, lambda x: starts_with(x, '{p}')))" for c, w in weights.items()) + " AS f FROM tok" for i, p in enumerate(prefixes))
    return f"""tok0 AS (SELECT {key}, {toks} FROM {source}), tok AS (SELECT *, {' + '.join(f'len(t_{c})' for c in columns)} AS len FROM tok0),
size AS (SELECT count(*) AS n, avg(len) AS avg_len FROM tok), per AS (SELECT * FROM ({per}) WHERE f > 0), df AS (SELECT p, count(*) AS n FROM per GROUP BY p),
scored AS (SELECT per.{key}, -sum(greatest(ln((size.n - df.n + 0.5) / (df.n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) AS bm25 FROM per JOIN df USING (p) CROSS JOIN size GROUP BY per.{key} HAVING count(*) = {len(prefixes)})"""


DOC_QUERY = "ther tion an"
DOC_BM25 = bm25_sql("docs", "id", search.DOCUMENT_WEIGHTS, ["ther", "tion", "an"])


@query(W("docs") + ", " + DOC_BM25 + " SELECT 'words' AS tier, id, title, document_number, legal_type, year, round(bm25, 6) AS bm25 FROM docs JOIN scored USING (id) ORDER BY round(bm25, 6), year DESC, title, id LIMIT 12")
def search_documents(spark, d):
    docs = b.docs(spark, d)
    return search.search_documents(docs, search.build_index(docs, "id", list(search.DOCUMENT_WEIGHTS), b.stored), DOC_QUERY, last_year=YEARS)


@query(W("docs") + ", " + DOC_BM25 + " SELECT id, round(bm25, 6) AS bm25 FROM scored")
def fts_bm25(spark, d):
    index = search.build_index(b.docs(spark, d), "id", list(search.DOCUMENT_WEIGHTS), b.stored)
    return search.match(index, search.query_prefixes(DOC_QUERY), search.DOCUMENT_WEIGHTS).select("id", F.round("bm25", 6).alias("bm25"))


@query(W("docs") + ", t AS (SELECT id, " + FOLDED.format("content") + " AS w FROM docs) SELECT id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'of'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'whth'))) > 0")
def fts_prefix_match(spark, d):
    index = search.build_index(b.docs(spark, d), "id", ["content"])
    return search.match(index, ["of", "whth"], {"content": 1.0}).select("id")


@query(W("docs") + ", t AS (SELECT id, unnest(" + FOLDED.format("content") + ") AS term FROM docs) SELECT term, count(*) AS n, count(DISTINCT id) AS documents FROM t GROUP BY 1")
def fts_tokenize(spark, d):
    terms = b.docs(spark, d).select("id", F.explode(text.fts_tokens(F.col("content"))).alias("term"))
    per = terms.groupBy("term", "id").agg(F.count("*").alias("k"))
    return per.groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("documents"))


@query(
    W("docs")
    + f""", m AS (SELECT *, replace(upper(document_number), '-', '/') AS q FROM docs), r AS (SELECT *, CASE WHEN q = '7/1997' THEN 0 WHEN starts_with(q, '7/1997/') THEN 1 WHEN starts_with(q, '7/1997') THEN 2 WHEN contains(upper(title), '7-1997') THEN 3 END AS match_rank FROM m)
SELECT id, document_number, match_rank FROM r WHERE match_rank IS NOT NULL ORDER BY match_rank, abs(length(document_number) - 6), {SANE} DESC NULLS LAST, issuance_date DESC, title, id LIMIT 12"""
)
def search_identifier(spark, d):
    hits = search.identifier_hits(b.docs(spark, d), "7-1997")
    return search.page(hits, search.identifier_order(YEARS)).select("id", "document_number", "match_rank")


PASSAGE_QUERY = "thtion erin"
PASSAGE_SQL = W("docs", "passages") + ", " + bm25_sql("passages", "pid", search.PASSAGE_WEIGHTS, ["thtion", "erin"])


@query(PASSAGE_SQL + " SELECT document_id, ordinal, round(bm25, 6) AS bm25 FROM scored JOIN passages USING (pid)")
def passage_bm25(spark, d):
    pieces = b.passages(spark, d)
    return pieces.join(search.match(search.build_index(pieces, "pid", list(search.PASSAGE_WEIGHTS)), search.query_prefixes(PASSAGE_QUERY), search.PASSAGE_WEIGHTS), "pid").select("document_id", "ordinal", F.round("bm25", 6).alias("bm25"))


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^0-9a-z/\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _bonus(c: str, phrase: float, word: float) -> str:
    return f"CASE WHEN contains({c}, 'thtion erin') THEN {phrase} ELSE 0 END + CASE WHEN contains({c}, 'thtion') THEN {word} ELSE 0 END + CASE WHEN contains({c}, 'erin') THEN {word} ELSE 0 END"


@query(
    PASSAGE_SQL
    + f""", top AS (SELECT p.document_id, ordinal, heading, text, title, issuance_date, bm25 FROM scored JOIN passages p USING (pid) JOIN docs ON document_id = id ORDER BY bm25, p.document_id, ordinal LIMIT 72),
s AS (SELECT *, round(-bm25 + {_bonus(_norm('title'), 14.0, 3.0)} + {_bonus(_norm('heading'), 10.0, 2.0)} + {_bonus(_norm('text'), 8.0, 1.0)}, 6) AS score FROM top)
SELECT document_id, ordinal, heading, score FROM s ORDER BY score DESC, issuance_date DESC, ordinal DESC, document_id LIMIT 6"""
)
def retrieve_passages(spark, d):
    pieces = b.passages(spark, d)
    return search.retrieve_passages(pieces, search.build_index(pieces, "pid", list(search.PASSAGE_WEIGHTS)), b.docs(spark, d), PASSAGE_QUERY)


@query()
def fts_snippet(spark, d):
    return b.docs(spark, d).select("id", search.snippet(F.col("content"), ["ther", "tion"]).alias("snippet"))


# -- text ------------------------------------------------------------------------------------------


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def fn_strip_tags(spark, d):
    return b.table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


def _entities(c: str) -> str:
    """Character references by DuckDB's own means: pieces between them, names from a map, numbers by chr."""
    import html.entities

    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    pattern = "&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
    names = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in html.entities.html5.items()) + "}"
    begins = ", ".join(f"CASE WHEN length(e) > {n} THEN named[e[1:{n}]] || substr(e, {n + 1}) END" for n in range(6, 1, -1))
    code = "CASE WHEN regexp_matches(e, '^#[xX]') THEN CAST('0x' || regexp_extract(e, '^#[xX]([0-9a-fA-F]+)', 1) AS BIGINT) ELSE CAST(regexp_extract(e, '^#([0-9]+)', 1) AS BIGINT) END"
    shown = f"CASE WHEN starts_with(e, '#') THEN chr(CAST({code} AS INTEGER)) ELSE coalesce(named[e], {begins}, '&' || e) END"
    return f"(SELECT string_agg(g || coalesce(v, ''), '' ORDER BY i) FROM (SELECT i, gaps[i] AS g, (SELECT {shown} FROM (SELECT found[i] AS e, {names} AS named) WHERE e IS NOT NULL) AS v FROM (SELECT regexp_extract_all({c}, '{pattern}', 1) AS found, string_split_regex({c}, '{pattern}') AS gaps, unnest(range(1, len(string_split_regex({c}, '{pattern}')) + 1)) AS i)))"


def _markdown(c: str) -> str:
    for pattern, new in ((r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"[`*_>{}\x0b]", " "), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"\s+\n", "\n"), (r"\n\s+", "\n"), (r"^\s+|\s+$", "")):
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return c


#: What every page gets at its end: references by name, by number, without a semicolon, and what only looks like one.
REFERENCES = "<p>&#272;i&#7873;u 1. &Aacute;p d&#x1EE5;ng &amp;lt; &copy &notin; &nosuch; 5 &lt 6 & 7</p>"


@query(
    f"WITH a AS (SELECT page_id, regexp_replace(concat(html, '{REFERENCES}'), '(?i)<br\\s*/?>', chr(10), 'g') AS x FROM pages), b AS (SELECT page_id, regexp_replace(x, '(?i)</(?:p|div|tr|td|table|dir|center|li|ul|ol|blockquote|h[1-6])>', chr(10), 'g') AS x FROM a), c AS (SELECT page_id, regexp_replace(x, '<[^>]+>', ' ', 'g') AS x FROM b), e AS (SELECT page_id, replace("
    + _entities("x")
    + ", chr(160), ' ') AS x FROM c) SELECT page_id, "
    + _markdown("x")
    + " AS text FROM e"
)
def fn_norm_html(spark, d):
    pages = b.table(spark, d, "pages").select("page_id", F.concat("html", F.lit(REFERENCES)).alias("html"))
    return pages.select("page_id", text.normalize_html(F.col("html")).alias("text"))


@query("SELECT doc_id, " + _markdown("text") + " AS text FROM documents")
def fn_norm_md(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.normalize_markdown(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(x) <= 280 THEN x ELSE concat(regexp_replace(substr(x, 1, 277), '\\s+$', ''), '...') END AS excerpt, CASE WHEN length(y) <= 220 THEN y ELSE concat(rtrim(substr(y, 1, 217)), '...') END AS summary FROM (SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS x, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS y FROM documents)")
def fn_excerpt(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"), text.summarize(F.col("text")).alias("summary"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents)")
def fn_ascii_fold(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.ascii_fold(F.col("text")).alias("folded"))


@query(W("docs") + " SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^0-9a-z\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM docs")
def fn_slugify(spark, d):
    return b.docs(spark, d).select("id", text.slugify(F.col("title")).alias("slug"))


@query(W("docs") + " SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(strip_accents(title)), '[0-9a-z]+'))), ' ') AS words FROM docs")
def fn_tokens_set(spark, d):
    return b.docs(spark, d).select("id", F.array_join(F.array_sort(text.token_set(F.col("title"))), " ").alias("words"))


@query(W("docs") + " SELECT id, sha256(concat_ws(chr(31), content, document_number, title)) AS hash FROM docs")
def fn_source_hash(spark, d):
    return b.docs(spark, d).select("id", F.sha2(F.concat_ws("\x1f", "content", "document_number", "title"), 256).alias("hash"))


STOP = "('" + "', '".join(segment.KEYWORD_STOPWORDS) + "')"


@query(
    W("docs")
    + f""", f AS (SELECT id, 0 AS k, 4 AS w, title AS x FROM docs UNION ALL SELECT id, 1, 3, document_number FROM docs UNION ALL SELECT id, 2, 1, excerpt FROM docs),
t AS (SELECT id, k, w, unnest(regexp_extract_all({_norm('x')}, '[0-9a-z]+')) AS token, generate_subscripts(regexp_extract_all({_norm('x')}, '[0-9a-z]+'), 1) AS pos FROM f),
s AS (SELECT id, token, sum(w) AS weight, min(k * 1000000 + pos) AS seen FROM t WHERE (length(token) >= 3 OR regexp_matches(token, '[0-9]')) AND token NOT IN {STOP} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, seen) AS place FROM s)
SELECT id AS document_id, CAST(place AS INTEGER) AS place, token AS keyword, CAST(weight AS BIGINT) AS weight FROM r WHERE place <= 48"""
)
def agg_keywords(spark, d):
    return segment.keywords(b.docs(spark, d), {"title": 4, "document_number": 3, "excerpt": 1})


@query(
    W("passages")
    + """, s AS (SELECT document_id, ordinal, heading, unnest(string_split(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(31), 'g'), chr(31))) AS text FROM passages),
c AS (SELECT document_id, ordinal, trim(text) AS text FROM s WHERE length(trim(text)) >= 60),
k AS (SELECT *, CASE WHEN contains(lower(text), 'erin') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'thtion') THEN 1 ELSE 0 END AS o, len(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')) AS n FROM c)
SELECT text, round(max(o + o / n), 6) AS score FROM k GROUP BY text ORDER BY 2 DESC, min(document_id * 1000 + ordinal), text LIMIT 3"""
)
def sentence_rank(spark, d):
    from ..operators.answer import findings

    return findings(b.passages(spark, d), "erin thtion", F.col("document_id") * 1000 + F.col("ordinal")).select("text", "score")


@query(
    W("docs")
    + """, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM docs)
SELECT id AS document_id, CAST(1 AS BIGINT) AS sections, CAST(sum(length(line) + 1) - 1 AS BIGINT) AS chars FROM l GROUP BY id"""
)
def seg_sections_plain(spark, d):
    """Documents without headings are one preamble; its text is the document's, stripped."""
    parts = segment.sections(b.docs(spark, d)).where("ordinal > 0")
    sizes = parts.groupBy("document_id").agg(F.count("*").alias("sections"))
    full = b.docs(spark, d).select(F.col("id").alias("document_id"), F.length("content").cast("long").alias("chars"))
    return sizes.join(full, "document_id")


PROFILE_SQL = W("docs") + ", prof AS (SELECT id, title AS heading_index, document_number AS citation_index FROM docs), " + bm25_sql("prof", "id", {"heading_index": 3.0, "citation_index": 2.0}, ["then", "an"])


def profile_index(spark: SparkSession, d: str) -> search.Index:
    table = b.docs(spark, d).select("id", F.col("title").alias("heading_index"), F.col("document_number").alias("citation_index"))
    return search.build_index(table, "id", ["heading_index", "citation_index"])


@query(PROFILE_SQL + " SELECT id, round(bm25, 6) AS bm25 FROM docs JOIN scored USING (id) ORDER BY round(bm25, 6), year DESC, title, id LIMIT 12")
def search_profile(spark, d):
    hits = search.match(profile_index(spark, d), search.query_prefixes("then an"), search.PROFILE_WEIGHTS)
    rows = b.docs(spark, d).join(hits, "id").withColumn("bm25", F.round("bm25", 6))
    return search.page(rows, [F.col("bm25"), F.col("year").desc(), F.col("title"), F.col("id")]).select("id", "bm25")


@query(PROFILE_SQL + " SELECT id FROM scored ORDER BY round(bm25, 6), id LIMIT 48")
def search_candidates(spark, d):
    return search.candidates(profile_index(spark, d), "then an")


@query(W("docs") + " SELECT legal_type, year, count(*) AS documents FROM docs WHERE contains(lower(issuing_authority), 'src1') GROUP BY ALL")
def api_home(spark, d):
    return search.facets(b.docs(spark, d), issuer="src1").groupBy("legal_type", "year").agg(F.count("*").alias("documents"))


@query("SELECT count(*) AS documents FROM documents")
def api_health(spark, d):
    return b.table(spark, d, "documents").agg(F.count("*").alias("documents"))
