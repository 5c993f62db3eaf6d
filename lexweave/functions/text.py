"""Text normalisation as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import functools
import html.entities
import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE = r"(?U)\s+"


@functools.cache
def _table(form: str, with_d: bool) -> tuple[str, str]:
    """(from, to) for ``translate``: letters that lose their marks, then marks that vanish."""
    source, target = [], []
    for code in range(0x80, 0x2000):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            continue
        bare = "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.combining(c))
        if with_d and char in "đĐ":
            bare = {"đ": "d", "Đ": "D"}[char]
        if len(bare) == 1 and bare != char:
            source.append(char)
            target.append(bare)
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space (any of Unicode) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), SPACE, " "))


def ascii_fold(c: Column) -> Column:
    """Lower case without diacritics, đ as d."""
    source, target = _table("NFKD", True)
    return strip(F.lower(F.translate(text_or_empty(c), source, target)))


def fts_fold(c: Column) -> Column:
    """Lower case without diacritics; đ stays, as in the full-text tokenizer."""
    source, target = _table("NFD", False)
    return F.lower(F.translate(text_or_empty(c), source, target))


def fts_tokens(c: Column) -> Column:
    """Runs of letters and digits, folded; a text without marks has nothing to fold but its case."""
    t = text_or_empty(c)
    return F.when(F.octet_length(t) == F.length(t), F.regexp_extract_all(F.lower(t), F.lit("[0-9a-z]+"), F.lit(0))).otherwise(F.regexp_extract_all(fts_fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def slugify(c: Column) -> Column:
    """Folded text, other signs out, spaces as hyphens."""
    kept = F.regexp_replace(ascii_fold(c), r"[^0-9a-z\s-]", "")
    return F.regexp_replace(F.regexp_replace(strip(kept), r"[\s-]+", "-"), "^-+|-+$", "")


def slug_anchor(c: Column) -> Column:
    """Anchor that keeps Vietnamese letters; ``section`` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(strip(F.lower(text_or_empty(c))), r"[^0-9a-z\x{00c0}-\x{1ef9}\s-]", ""), r"\s+", "-")
    return F.when(kept == "", F.lit("section")).otherwise(kept)


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_fold(c), F.lit("[0-9a-z]+"), F.lit(0)))


def ascii_words(c: Column) -> Column:
    """Lower-case text without diacritics, of letters, digits, slashes, dots and hyphens, with single spaces."""
    source, target = _table("NFD", True)
    return F.lower(strip(F.regexp_replace(F.regexp_replace(F.translate(text_or_empty(c), source, target), r"[^0-9A-Za-z\s/.-]", " "), r"\s+", " ")))


def plain_field(c: Column) -> Column:
    """Folded letters and digits with single spaces: the form of labels and rule fields."""
    return F.trim(F.regexp_replace(ascii_fold(c), r"[^0-9a-z]+", " "))


def retrieval_text(c: Column) -> Column:
    """Folded text of letters, digits, slashes and hyphens with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_fold(c), r"[^0-9a-z/\s-]", " "), r"\s+", " "))


def normalize_markdown(c: Column) -> Column:
    """Markdown without images, link targets, decoration and blank lines."""
    out = F.regexp_replace(text_or_empty(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]+\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"[`*_>{}\x0b]", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"(?U)\s+\n", "\n")
    out = F.regexp_replace(out, r"(?U)\n\s+", "\n")
    return strip(out)


#: A character reference: decimal, hexadecimal, or a name that may lack its semicolon.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: What a browser shows for numbers 128 to 159: Windows code page 1252, or nothing.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
#: Ranges of code points that stand for no character and are left out.
_NONE = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF))


def _entity(name: Column, named: Column) -> Column:
    """The characters of a reference without its ampersand, or null where it is none."""
    body = F.regexp_replace(name, ";$", "")
    code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(body, 3, 32), 16, 10)).otherwise(F.substring(body, 2, 32))
    # the legal names without a semicolon are the shorter ones; the longest that the name begins with counts
    begins = [F.when(F.length(name) > n, F.concat(F.try_element_at(named, F.substring(name, 1, n)), F.substring(name, n + 1, 64))) for n in range(6, 1, -1)]
    return F.when(name.startswith("#"), let(F.coalesce(code.try_cast("decimal(38,0)"), F.lit(-1)), _character)).otherwise(F.coalesce(F.try_element_at(named, name), *begins))


def _character(n: Column) -> Column:
    windows = F.from_json(F.lit(json.dumps({str(k): v for k, v in _WINDOWS.items()})), "map<string,string>")
    nothing = F.lit(False)
    for low, high in _NONE:
        nothing = nothing | n.between(low, high)
    bad = (n <= 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    point = F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    return F.when(bad, F.lit("\ufffd")).when(n.between(128, 159), F.coalesce(F.try_element_at(windows, n.cast("string")), F.lit(""))).when(nothing | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE), F.lit("")).otherwise(point)


def unescape_entities(c: Column) -> Column:
    """Character references of all standard names and both number forms as characters, in one scan, so that nothing is undone twice."""
    named = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")

    def put(x: Column) -> Column:
        shown = F.transform(x["names"], lambda n: F.coalesce(_entity(n, named), F.concat(F.lit("&"), n)))
        return F.array_join(F.zip_with(x["gaps"], shown, lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), "")

    pieces = F.struct(F.split(c, REFERENCE, -1).alias("gaps"), F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)).alias("names"))
    return F.when(c.contains("&"), let(pieces, put)).otherwise(c)


def normalize_html(c: Column) -> Column:
    """Text of an HTML page: block ends and breaks are line feeds, tags go, entities are characters."""
    out = F.regexp_replace(text_or_empty(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|tr|td|table|dir|center|li|ul|ol|blockquote|h[1-6])>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.replace(unescape_entities(out), F.lit(" "), F.lit(" "))
    return normalize_markdown(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(text_or_empty(c), r"<[^>]+>", " "))


def cut(c: Column, length: int) -> Column:
    """At most ``length`` characters, the last three of a cut text being dots."""
    return F.when(F.length(c) <= length, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, length - 3), r"(?U)\s+$", ""), F.lit("...")))


def excerpt(c: Column, length: int = 280) -> Column:
    return cut(strip(F.replace(text_or_empty(c), F.lit("\n"), F.lit(" "))), length)


def summarize(c: Column, length: int = 220) -> Column:
    return cut(squeeze(c), length)


def unique_in_order(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))


def find_all(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """Every match as struct(begin, end, g0...): places count from 0; groups as asked for.

    Built from the pieces between matches, since no built-in returns places.
    """
    pieces = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.split(text, pattern, -1).alias("gaps"),
        *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{k}") for k, g in enumerate(groups)],
    )

    def places(p: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(F.arrays_zip(p["gaps"], p["whole"]), F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["gaps"]) + F.length(x["whole"]))
        found = F.transform(p["whole"], lambda m, i: F.struct((before(i) + F.length(F.get(p["gaps"], i))).alias("b"), F.length(m).alias("n"), i.alias("i")))
        return F.transform(found, lambda x: F.struct(x["b"].alias("begin"), (x["b"] + x["n"]).alias("end"), *[F.get(p[f"g{k}"], x["i"]).alias(f"g{k}") for k in range(len(groups))]))

    # most texts hold no match, which one scan tells
    return F.when(text.rlike(pattern), let(pieces, places)).otherwise(F.when(text.isNotNull(), F.array()))


# -- dates ---------------------------------------------------------------------------------------

FIRST_YEAR = 1800


def last_sane_year() -> Column:
    """The last year that a document may have: the next one."""
    return F.year(F.current_date()) + 1


def parsed_date(c: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.trim(text_or_empty(c)), F.lit("d/M/yyyy")))


def year_hint(last_year: int, *texts: Column) -> Column:
    """The first year 1900 to ``last_year`` named in the texts, in their order."""
    found = [F.get(F.filter(F.transform(F.regexp_extract_all(text_or_empty(t), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: y <= last_year), F.lit(0)) for t in texts]
    return F.coalesce(*found) if found else F.lit(None).cast("int")


def repair_date(c: Column, last_year: int, *hints: Column) -> Column:
    """struct(issuance_date, year): implausible years are taken from hints, or lowered by 1000; else the year is null.

    A 29 February that the new year lacks leaves the date as it is.
    """
    raw = F.trim(text_or_empty(c))
    date = parsed_date(c)
    year = F.year(date)
    new = F.when(year.between(FIRST_YEAR, last_year), year).otherwise(F.coalesce(year_hint(last_year, *hints), F.when((year >= 3000) & (year - 1000).between(FIRST_YEAR, last_year), year - 1000)))
    moved = F.concat(F.date_format(date, "dd/MM/"), F.lpad(new.cast("string"), 4, "0"))
    good = date.isNotNull() & new.isNotNull()
    kept = good & (year == new)
    valid = good & F.try_to_timestamp(moved, F.lit("dd/MM/yyyy")).isNotNull()
    return F.struct(F.when(kept, raw).when(valid, moved).otherwise(raw).alias("issuance_date"), F.when(kept | valid, new).alias("year"))
