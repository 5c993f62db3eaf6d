"""Preparing documents for readers: anchors and outlines, paragraphs, preambles, tables and links, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import find_all, let, strip, text_or_empty
from .segment import line_label, sections

# -- fixed values ---------------------------------------------------------------------------------

BREAK_BEFORE = (
    r"PHẦN\s+[IVXLC0-9A-Za-z\-./]+", r"Phần\s+[IVXLC0-9A-Za-z\-./]+", r"CHƯƠNG\s+[IVXLC0-9A-Za-z\-./]+", r"Chương\s+[IVXLC0-9A-Za-z\-./]+", r"MỤC\s+[IVXLC0-9A-Za-z\-./]+", r"Mục\s+[IVXLC0-9A-Za-z\-./]+",
    r"Điều\s+\d+[A-Za-z0-9\-./]*[.:]?", r"RA\s+SẮC\s+LỆNH:", r"QUYẾT\s+ĐỊNH:", r"NGHỊ\s+QUYẾT:", r"THÔNG\s+TƯ:",
)
PREAMBLE_WORDS = ("Căn cứ", "Chiếu theo", "Xét", "Theo đề nghị", "Sau khi", "CAN CU", "CHIEU THEO", "XET", "THEO DE NGHI", "SAU KHI")
ENACTMENTS = ("RA SẮC LỆNH:", "RA SAC LENH:", "QUYẾT ĐỊNH:", "QUYET DINH:", "NGHỊ QUYẾT:", "NGHI QUYET:", "THÔNG TƯ:", "THONG TU:", "LUẬT:", "LUAT:")
OUTLINE_TYPES = ("heading", "chapter", "part", "section", "article")
RAW_NUMBER = r"\b([0-9]{1,4}[a-z]?(?:[/-][0-9]{2,4})?(?:[/-][A-Za-z0-9\x{00c0}-\x{1ef9}]*[A-Za-z\x{00c0}-\x{1ef9}][A-Za-z0-9\x{00c0}-\x{1ef9}]*)+)\b"
RAW_TYPED = (
    r"(?iu)\b(?:Sắc lệnh|Pháp lệnh|Nghị định|Nghị quyết|Quyết định|Chỉ thị|Thông tư(?: liên tịch)?|Lệnh|Luật|Bộ luật)\s*số\s*"
    r"([0-9]{1,4}(?:[/-][0-9]{2,4})?(?:[/-][A-Za-z0-9\x{00c0}-\x{1ef9}\-]+)?)\b"
)
TITLE_CHARS, TITLE_WORDS = 48, 4
PREFIX_CHARS = 6


def display_line(c: Column) -> Column:
    """A line without runs of stars, with single spaces and spaced bars, and no hyphens at its ends."""
    out = F.regexp_replace(text_or_empty(c), r"\*{3,}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s*\|\s*", " | "), r"(?U)\s+", " ")
    return strip(F.regexp_replace(out, r"^[ \-\t]+|[ \-\t]+$", ""))


def paragraphs(c: Column) -> Column:
    """Paragraphs of a text: cut at blank lines, and before every heading or enactment inside a line."""
    clean = F.regexp_replace(text_or_empty(c), r"\r\n?", "\n")
    broken = F.regexp_replace(clean, rf"(?U)\s+(?={'|'.join(BREAK_BEFORE)})", "\n\n")
    lines = F.transform(F.split(broken, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    joined = F.array_join(F.transform(lines, lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x)), "\n")
    return F.filter(F.transform(F.split(joined, r"\n{2,}"), strip), lambda p: p != "")


def preamble_clauses(c: Column) -> Column:
    """A preamble cut before each of its opening words; the whole line if there is none."""
    pieces = F.filter(F.transform(F.split(display_line(c), rf"(?={'|'.join(PREAMBLE_WORDS)})"), strip), lambda p: p != "")
    return let(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(display_line(c))))


def title_and_preamble(c: Column) -> Column:
    """struct(title, preamble): a preamble or enactment inside a title of 48 characters and four words or more is cut off; else it is null."""

    def place(line: Column, words: tuple[str, ...]) -> Column:
        return F.get(find_all(line, rf"(?iu)\s+(?:{'|'.join(words)})\b"), F.lit(0))["begin"]

    def cut(line: Column) -> Column:
        at = F.coalesce(place(line, PREAMBLE_WORDS), place(line, ENACTMENTS))
        return let(F.struct(line.alias("line"), at.alias("at")), lambda x: _title(x["line"], x["at"]))

    return let(display_line(c), cut)


def _title(line: Column, at: Column) -> Column:
    title = F.regexp_replace(strip(F.substring(line, F.lit(1), at)), r"^[ ;:]+|[ ;:]+$", "")
    rest = strip(F.substring(line, at + 1, F.length(line)))
    good = (at >= TITLE_CHARS) & (F.size(F.filter(F.split(title, r"\s+"), lambda w: w != "")) >= TITLE_WORDS) & (rest != "")
    kind = "struct<title:string,preamble:string>"
    return F.when(good, F.struct(title.alias("title"), rest.alias("preamble")).cast(kind)).otherwise(F.struct(line.alias("title"), F.lit(None).alias("preamble")).cast(kind))


def table_block(c: Column) -> Column:
    """struct(header, body) of a block whose lines all have two bars or more, with rows as wide as the header; null if it is none."""
    lines = F.filter(F.transform(F.split(text_or_empty(c), r"\r\n|[\n\r]"), strip), lambda x: x != "")
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))

    def cells(x: Column) -> Column:
        bare = F.regexp_replace(x, r"(?U)^[\s|]+|[\s|]+$", "")
        return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(bare, r"\|"), strip))

    rule = lambda row: F.forall(row, lambda x: x.rlike(r"(?U)^[|:\-\s]+$"))

    def parsed(x: Column) -> Column:
        rows = F.filter(F.transform(x, cells), lambda r: (F.size(r) >= 2) & ~rule(r))
        return let(rows, lambda r: _table(r))

    return let(lines, lambda x: F.when((F.size(x) >= 2) & F.forall(x, lambda y: bars(y) >= 2), parsed(x)))


def _table(rows: Column) -> Column:
    header = F.get(rows, F.lit(0))
    body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: (F.size(r) == F.size(header)) & F.exists(r, lambda x: x != ""))
    return let(body, lambda b: F.when(F.size(b) > 0, F.struct(header.alias("header"), b.alias("body"))))


def markup(docs: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(document_id, content): a line with its anchor goes before the line that opens each section, where every section has such a line."""
    lines = F.split(text_or_empty(F.col(content)), r"\r\n|[\n\r\x0b\x0c\x85\x{2028}\x{2029}]")
    heads = F.filter(F.transform("lines", lambda x, i: F.when(line_label(x).isNotNull(), i)), lambda i: i.isNotNull())
    cut = docs.select(F.col(id_col).alias("document_id"), lines.alias("lines")).withColumn("heads", heads)
    # a preamble has no line of its own that opens it: in a document with one, no line has an anchor
    named = sections(docs, id_col, content).where("ordinal > 0").groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "anchor"))), lambda x: x["anchor"]).alias("named"))
    joined = cut.join(named, "document_id", "left")
    anchors = F.map_from_entries(F.zip_with("heads", "named", lambda i, a: F.struct(i, a)))
    marked = F.transform("lines", lambda x, i: F.concat(F.coalesce(F.concat(F.lit('<a id="'), F.try_element_at("anchors", i), F.lit('" class="anchor-target"></a>\n')), F.lit("")), x))
    return joined.withColumn("anchors", F.when((F.size("heads") > 0) & (F.size("heads") == F.size("named")), anchors)).select("document_id", F.array_join(marked, "\n").alias("content"))


def outline(parts: DataFrame) -> DataFrame:
    """(document_id, place, heading, anchor) of the sections that readers jump to; ``parts`` as made by :func:`sections`."""
    return parts.where(F.col("section_type").isin(*OUTLINE_TYPES)).select("document_id", F.col("ordinal").alias("place"), F.col("label").alias("heading"), "anchor")


# -- references in shown text ----------------------------------------------------------------------


def raw_references(c: Column) -> Column:
    """References as they stand in a text: array of struct(begin, end, raw), by place, the longest of equal places first."""
    bare = F.transform(find_all(c, RAW_NUMBER, (1,)), lambda m: _span(m, False))
    spans = F.concat(bare, F.transform(find_all(c, RAW_TYPED, (1,)), lambda m: _span(m, True)))
    return F.transform(F.array_sort(spans), lambda x: F.struct(x["begin"].alias("begin"), (x["begin"] + F.length(x["raw"])).alias("end"), x["raw"].alias("raw")))


def _span(m: Column, typed: bool) -> Column:
    # a typed reference ends with its number
    begin = m["end"] - F.length(m["g0"]) if typed else m["begin"]
    return F.struct(begin.alias("begin"), (-F.length(m["g0"])).alias("length"), m["g0"].alias("raw"))


def reference_key(c: Column) -> Column:
    """A reference without diacritics (đ stays) and without marks at its end, in lower case."""
    from ..functions.text import fts_fold

    return F.regexp_replace(fts_fold(c), r"[-,. ]+$", "")


def best_match(raw: Column, known: Column) -> Column:
    """struct(number, id) of the entry of ``known`` (an array of such) that a reference means: an equal number, else the first of six characters or more that goes on where the other ends, by a slash."""

    def pick(key: Column) -> Column:
        equal = F.filter(known, lambda k: k["number"] == key)
        near = F.filter(known, lambda k: (F.length(k["number"]) >= PREFIX_CHARS) & (F.startswith(key, F.concat(k["number"], F.lit("/"))) | F.startswith(k["number"], F.concat(key, F.lit("/")))))
        return F.coalesce(F.get(equal, F.lit(0)), F.get(near, F.lit(0)))

    return let(reference_key(raw), pick)


def linked(c: Column, known: Column) -> Column:
    """A text with a link around every reference that ``known`` answers; of references at one place the first that is answered counts."""
    found = F.transform(raw_references(c), lambda r: F.struct(r["begin"].alias("begin"), r["end"].alias("end"), r["raw"].alias("raw"), best_match(r["raw"], known)["id"].alias("id")))
    answered = F.filter(found, lambda r: r["id"].isNotNull())
    first = let(answered, lambda a: F.filter(a, lambda r, i: F.coalesce(r["begin"] >= F.array_max(F.transform(F.slice(a, F.lit(1), i), lambda x: x["end"])), F.lit(True))))

    def put(text: Column, refs: Column) -> Column:
        escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        link = lambda r: F.concat(F.lit('<a href="/documents/'), r["id"].cast("string"), F.lit('" class="doc-ref-link" data-target-document-id="'), r["id"].cast("string"), F.lit('" data-reference="'), escaped(r["raw"]), F.lit('">'), r["raw"], F.lit("</a>"))
        before = lambda r, i: F.substring(text, F.coalesce(F.get(refs, i - 1)["end"], F.lit(0)) + 1, r["begin"] - F.coalesce(F.get(refs, i - 1)["end"], F.lit(0)))
        tail = F.coalesce(F.try_element_at(refs, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(refs, lambda r, i: F.concat(before(r, i), link(r))), ""), F.substring(text, tail + 1, F.length(text)))

    return let(F.struct(text_or_empty(c).alias("t"), first.alias("r")), lambda x: put(x["t"], x["r"]))
