"""Cutting documents into sections, passages, clauses, keywords and retrieval profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.legal import link_type, normalize_number, reference_label, reference_year, references
from ..functions.text import ascii_fold, let, normalize_markdown, plain_field, retrieval_text, slug_anchor, squeeze, strip, summarize, text_or_empty, unique_in_order

#: Fixed values.
FALSE_HEADINGS = ("ban hanh kem theo", "theo quyet dinh so", "co hieu luc", "chiu trach nhiem")
KEYWORD_STOPWORDS = "ban bo cac can cho co cua da den dia dieu duoc hai khi mot nay nguoi nhung quy quyet so tai theo thi thu thuc trach tren trong tu van viec voi xac".split()
FIRST_HEADING = "Mở đầu"
TITLE_LABEL = "Tiêu đề"
PASSAGE_CHARS = 1400
BEFORE, AFTER = 180, 140


def _uppercaseish(line: Column) -> Column:
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    upper = F.regexp_replace(letters, r"[^\p{Lu}]", "")
    return (F.length(letters) > 0) & (F.length(upper) >= 0.72 * F.length(letters))


def _is_heading(line: Column) -> Column:
    """Whether a chapter, part or section line is one, not a sentence that begins like one."""
    veto = ascii_fold(line).rlike("|".join(FALSE_HEADINGS)) | line.contains(";")
    loose = ~_uppercaseish(line) & (line.endswith(".") | (F.size(F.split(squeeze(line), " ")) > 18))
    return ~(veto | loose)


def line_label(raw: Column) -> Column:
    """struct(section_type, label) where a line begins a section, else null."""
    # most lines begin no section, which their first word tells
    begins = raw.rlike(r"(?iuU)^\s*(?:#|Điều|Dieu|Chương|Chuong|Phần|Phan|Mục|Muc)")
    return F.when(begins, let(F.struct(raw.alias("raw"), strip(raw).alias("line")), lambda x: _line_label(x["raw"], x["line"])))


def _line_label(raw: Column, line: Column) -> Column:
    mark = r"(?iu)^((?:{})\s+[IVXLC0-9A-Za-z\-./]+.*)$"
    rules = [
        (raw.rlike(r"^#{1,6}\s+.*$"), "heading", strip(F.regexp_extract(raw, r"^#{1,6}\s+(.*)$", 1))),
        (line.rlike(r"(?iu)^(?:Điều|Dieu)\s+\d+"), "article", F.regexp_extract(line, r"(?iu)^((?:Điều|Dieu)\s+\d+[A-Za-z0-9\-./]*)", 1)),
    ]
    for kind, words in (("chapter", "Chương|Chuong"), ("part", "Phần|Phan"), ("section", "Mục|Muc")):
        rules.append((line.rlike(mark.format(words)) & _is_heading(line), kind, line))
    out = None
    for test, kind, label in rules:
        value = F.struct(F.lit(kind).alias("section_type"), label.alias("label"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.when(line != "", out)


def sections(docs: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(document_id, ordinal, section_type, label, anchor, text): ordinal 0 is the title, text before the first heading a preamble.

    Lines are numbered inside the row, so one shuffle by document serves all
    windows. Sections without text are left out.
    """
    lines = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(text_or_empty(F.col(content)), r"\r\n|[\n\r\x0b\x0c\x85\x{2028}\x{2029}]")).alias("pos", "line"))
    marked = lines.withColumn("mark", line_label(F.col("line")))
    by_line = Window.partitionBy("document_id").orderBy("pos")
    numbered = marked.withColumn("n", F.sum(F.col("mark").isNotNull().cast("int")).over(by_line))
    joined = numbered.groupBy("document_id", "n").agg(F.max("mark").alias("mark"), strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    full = joined.where("text != ''").select("document_id", "n", F.coalesce("mark.section_type", F.lit("preamble")).alias("section_type"), F.coalesce("mark.label", F.lit(FIRST_HEADING)).alias("label"), "text")
    by_section = Window.partitionBy("document_id").orderBy("n")
    slugged = full.withColumn("slug", slug_anchor(F.col("label")))
    same = Window.partitionBy("document_id", "slug").orderBy("n")
    body = slugged.select("document_id", F.row_number().over(by_section).alias("ordinal"), "section_type", "label", F.concat("slug", F.lit("-"), F.row_number().over(same)).alias("anchor"), "text")
    title = docs.select(F.col(id_col).alias("document_id"), F.lit(0).alias("ordinal"), F.lit("title").alias("section_type"), F.lit(TITLE_LABEL).alias("label"), F.lit("tieu-de").alias("anchor"), F.lit("").alias("text"))
    return title.unionByName(body)


def _packed(pieces: Column, sep: str, most: int) -> Column:
    """Pieces joined in order as long as ``most`` characters allow; a longer piece stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        longer = F.concat(acc["open"], F.lit(sep), piece)
        fits = F.length(longer) <= most
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), piece.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), longer.alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), piece.alias("open")))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def passages(docs: DataFrame, id_col: str = "id", content: str = "content", most: int = PASSAGE_CHARS) -> DataFrame:
    """(document_id, ordinal, heading, text): text under each heading or article, long ones packed from whole sentences."""
    lines = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(normalize_markdown(F.col(content)), "\n")).alias("pos", "line"))
    line = strip(F.col("line"))
    heading = F.when(line.rlike(r"^#{1,6}\s+\S"), strip(F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1))).when(line.rlike(r"(?iu)^(?:Điều|Dieu)\s+\d+"), F.regexp_extract(line, r"(?iu)^((?:Điều|Dieu)\s+\d+[A-Za-z0-9\-./]*)", 1))
    marked = lines.select("document_id", "pos", line.alias("line"), heading.alias("heading")).where("line != ''")
    w = Window.partitionBy("document_id").orderBy("pos")
    numbered = marked.withColumn("n", F.sum(F.col("heading").isNotNull().cast("int")).over(w))
    grouped = numbered.groupBy("document_id", "n").agg(F.max("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.;:!?])\s+"), strip), lambda s: s != "")
    cut = F.when(F.length("text") <= most, F.array("text")).otherwise(_packed(sentences, " ", most))
    rows = grouped.select("document_id", "n", F.coalesce("heading", F.lit(FIRST_HEADING)).alias("heading"), F.posexplode(cut).alias("k", "text"))
    return rows.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("n", "k")).alias("ordinal"), "heading", "text")


def clause_units(text: Column, most: int = 12) -> Column:
    """Distinct clauses of a text, shortened: lines, and long lines cut at semicolons, bullets or sentences."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text_or_empty(text), r"\r\n?", "\n"), "\n"), strip), lambda x: x != "")
    tidy = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")

    def pieces(x: Column) -> Column:
        marks = tidy(F.split(x, r";|•|-\s+"))
        return F.when(F.length(x) <= 220, F.array(x)).when(F.size(marks) > 1, marks).otherwise(tidy(F.split(x, r"(?<=[.;:!?])\s+")))

    def taken(a: Column, piece: Column) -> Column:
        unit = let(summarize(piece, 200), lambda u: F.struct(u.alias("u"), plain_field(u).alias("k")))
        new = lambda x: (F.length(x["k"]) >= 12) & ~F.array_contains(F.transform(a, lambda y: y["k"]), x["k"])
        return let(unit, lambda x: F.when(new(x), F.array_append(a, x)).otherwise(a))

    # the first of equals; what comes behind the last one taken is not looked at
    room = lambda f: lambda a, x: F.when(F.size(a) < most, f(a, x)).otherwise(a)
    found = F.aggregate(lines, F.array().cast("array<struct<u:string,k:string>>"), room(lambda a, line: F.aggregate(pieces(line), a, room(taken))))
    return F.transform(found, lambda x: x["u"])


def keywords(docs: DataFrame, weights: dict[str, int], id_col: str = "id", most: int = 48) -> DataFrame:
    """(document_id, place, keyword, weight): the words of the weighted fields, ties by first occurrence."""

    def field(k: int, c: str, w: int) -> Column:
        return F.transform(F.regexp_extract_all(retrieval_text(F.col(c)), F.lit("[0-9a-z]+"), F.lit(0)), lambda t, i: F.struct(t.alias("token"), F.lit(w).alias("weight"), (F.lit(k).cast("long") * (1 << 32) + i).alias("at")))

    fields = [field(k, c, w) for k, (c, w) in enumerate(weights.items())]
    words = docs.select(F.col(id_col).alias("document_id"), F.inline(F.flatten(F.array(*fields))))
    kept = words.where(((F.length("token") >= 3) | F.col("token").rlike("[0-9]")) & ~F.col("token").isin(*KEYWORD_STOPWORDS))
    summed = kept.groupBy("document_id", "token").agg(F.sum("weight").alias("weight"), F.min("at").alias("at"))
    w = Window.partitionBy("document_id").orderBy(F.col("weight").desc(), F.col("at"))
    return summed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("document_id", "place", F.col("token").alias("keyword"), "weight")


def source_hash(*fields: str) -> Column:
    """SHA-256 of the fields, null as empty, in a form where no two records collide."""
    return F.sha2(F.to_json(F.struct(*[text_or_empty(F.col(c)).alias(c) for c in sorted(fields)])), 256)


def profiles(docs: DataFrame, pieces: DataFrame, weights: dict[str, int], hashed: tuple[str, ...]) -> DataFrame:
    """Retrieval profile of each document: headings, articles, citations, keywords, chunk count and hash."""
    content = retrieval_text(F.col("content"))
    own = docs.select(
        F.col("id").alias("document_id"),
        F.array_join(F.slice(unique_in_order(F.regexp_extract_all(content, F.lit(r"\bdieu\s+\d+[a-z]?\b"), F.lit(0))), 1, 128), "\n").alias("article_index"),
        F.array_join(F.slice(unique_in_order(F.transform(F.regexp_extract_all(content, F.lit(r"\b\d{1,4}/\d{4}/[0-9a-z][0-9a-z/-]{1,30}\b"), F.lit(0)), lambda x: F.replace(F.upper(x), F.lit("-"), F.lit("/")))), 1, 128), "\n").alias("citation_index"),
        source_hash(*hashed).alias("source_hash"),
    )
    heads = pieces.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "heading"))), lambda x: retrieval_text(x["heading"])).alias("h"))
    heads = heads.select("document_id", "chunk_count", F.array_join(F.filter(unique_in_order(F.col("h")), lambda x: x != "mo dau"), "\n").alias("heading_index"))
    words = keywords(docs, weights).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]), " ").alias("keyword_index"))
    return own.join(heads, "document_id", "left").join(words, "document_id", "left").select("document_id", text_or_empty(F.col("heading_index")).alias("heading_index"), "article_index", "citation_index", text_or_empty(F.col("keyword_index")).alias("keyword_index"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "source_hash")


def mentions(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """References of each section to numbers other than its own document's, with what stands around them."""
    own = docs.select(F.col("id").alias("document_id"), normalize_number(F.col("document_number")).alias("own_number"))
    folded = parts.select("document_id", F.col("ordinal").alias("section_ordinal"), ascii_fold(F.col("text")).alias("t"))
    found = folded.select("document_id", "section_ordinal", "t", F.explode(references(F.col("t"))).alias("m")).join(own, "document_id").where("m.number != own_number")
    before = F.substring("t", F.greatest(F.col("m.begin") - BEFORE, F.lit(0)) + 1, F.least(F.col("m.begin"), F.lit(BEFORE)))
    after = F.substring("t", F.col("m.end") + 1, F.lit(AFTER))
    seen = found.select("document_id", "section_ordinal", "m", before.alias("before"), after.alias("after")).withColumn("window", F.trim(F.concat_ws(" ", "before", "after")))
    told = seen.select(
        "document_id", "section_ordinal", F.col("m.begin").alias("begin"), F.col("m.untyped").alias("untyped"), F.col("m.length").alias("len"),
        F.col("m.raw").alias("raw_reference"), F.col("m.number").alias("referenced_number"), F.col("m.hint").alias("legal_type_hint"),
        link_type(F.col("before")).alias("l"), reference_label(F.col("window")).alias("referenced_label"),
        F.coalesce(reference_year(F.col("after")), reference_year(F.col("window"))).alias("reference_year"), F.col("window").alias("reference_context"),
    )
    key = ["document_id", "section_ordinal", "referenced_number", F.col("l.link_type"), F.coalesce("referenced_label", F.lit("")), F.coalesce("legal_type_hint", F.lit("")), F.coalesce("reference_year", F.lit(0))]
    place = [F.col("begin"), F.col("untyped"), F.col("len")]
    first = told.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*place))).where("k = 1")
    order = F.row_number().over(Window.partitionBy("document_id", "section_ordinal").orderBy(*place))
    return first.select(
        F.col("document_id").alias("source_document_id"), "section_ordinal", order.alias("mention_order"), "raw_reference", "referenced_number", "referenced_label", F.col("l.cue").alias("cue_phrase"), F.col("l.link_type").alias("link_type"),
        "legal_type_hint", "reference_year", "reference_context", F.when(F.col("l.cue").isNotNull() | F.col("referenced_label").isNotNull(), "high").otherwise("medium").alias("confidence"),
    )
