"""Document numbers, references, labels and issuers of legal texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ascii_fold, find_all, let, squeeze, strip, summarize, text_or_empty

# -- fixed values ---------------------------------------------------------------------------------

NUMBER = r"\b\d+[a-z]?(?:[/-]\d{2,4})?(?:[/-][0-9a-z]*[a-z][0-9a-z]*)+\b"
TYPED_NUMBER = (
    r"\b(bo luat|luat|phap lenh|sac lenh|lenh|nghi quyet|nghi dinh|quyet dinh|chi thi|thong tu lien tich|thong tu)"
    r"\s*(?:so\s*[:.]?\s*)?(\d+(?:[/-]\d{2,4})?(?:[/-][0-9a-z]+)?)\b"
)
TYPE_ABBREVIATIONS = {
    "sac lenh": ("sl",), "phap lenh": ("pl",), "nghi dinh": ("nd", "nd-cp"), "nghi quyet": ("nq", "nq-cp", "nq-hdnd", "nq-qh"),
    "quyet dinh": ("qd", "qd-ttg", "qd-ubnd"), "chi thi": ("ct", "ct-ttg", "ct-ubnd"), "thong tu": ("tt",), "thong tu lien tich": ("ttlt",),
    "luat": ("qh",), "bo luat": ("qh",), "lenh": ("l",),
}
LOCAL_NUMBERS = ("qd-ubnd", "kh-ubnd", "ct-ubnd", "tb-ubnd", "nq-hdnd", "qd-hdnd")
RELATION_CUES = {
    "replaces": (r"\bbai bo(?: toan bo)?\b", r"\bthay the\b", r"\bhuy bo\b"),
    "amends": (r"\bsua doi(?:, bo sung)?\b", r"\bbo sung mot so dieu\b", r"\bdinh chinh\b"),
    "guides": (r"\bhuong dan(?: thi hanh| thuc hien)?\b", r"\bquy dinh chi tiet\b", r"\btrien khai thuc hien\b"),
}
LINK_CUES = {
    "replaces": (r"\bbai bo(?: toan bo)?\b", r"\bthay the\b", r"\bhuy bo\b"),
    "amends": (r"\bsua doi(?:, bo sung)?\b", r"\bbo sung(?: mot so dieu)?\b", r"\bdinh chinh\b"),
    "guides": (r"\bhuong dan(?: thi hanh| thuc hien)?\b", r"\bquy dinh chi tiet\b"),
    "implements": (r"\btrien khai thuc hien\b", r"\bthi hanh\b"),
    "basis_for": (r"\bcan cu\b", r"\btheo quy dinh tai\b"),
}
RELATION_ORDER = ("amends", "replaces", "guides")
CITATION_ORDER = ("amends", "replaces", "guides", "implements", "basis_for", "cites")
LABELS = {"amends": "Amends", "replaces": "Replaces", "guides": "Guides", "basis_for": "Legal basis", "implements": "Implements", "cites": "Cites"}
INVERSE_LABELS = {"amends": "Amended by", "replaces": "Replaced by", "guides": "Guided by", "basis_for": "Used as legal basis by", "implements": "Implemented by", "cites": "Cited by"}
LOCALITY_STOPWORDS = ("giai", "doan", "tren", "dia", "ban", "kem", "theo", "do", "hanh", "quy", "dinh", "ve", "cua", "thuc", "hien")
NORMATIVE_TYPES = ("luat", "nghi dinh", "thong tu", "nghi quyet", "quyet dinh", "chi thi", "lenh", "van ban hop nhat")
ADMINISTRATIVE_TYPES = ("cong van", "ke hoach", "huong dan", "thong bao")
LOCAL_ISSUERS = ("uy ban nhan dan", "ubnd", "tinh ", "thanh pho ", "phuong ", "xa ", "quan ", "huyen ", "dac khu")
CENTRAL_ISSUERS = (
    "chinh phu", "thu tuong chinh phu", "van phong chinh phu", "quoc hoi", "uy ban thuong vu quoc hoi", "chu tich nuoc", "ngan hang nha nuoc", "hoi dong bau cu quoc gia",
    "toa an nhan dan toi cao", "vien kiem sat nhan dan toi cao", "bo ", "bo,", "bo quoc phong", "bo tu phap", "bo tai chinh", "bo cong an", "bo nong nghiep", "bo giao duc",
)
ARTICLE = r"\bdieu\s+(\d+[a-z]?)\b"
CLAUSE = r"\bkhoan\s+(\d+[a-z]?)\b"
POINT = r"\bdiem\s+([a-z])\b"

# -- numbers --------------------------------------------------------------------------------------


def normalize_number(c: Column) -> Column:
    return F.regexp_replace(ascii_fold(c), r"[^0-9a-z/-]", "")


def number_parts(c: Column) -> Column:
    return F.filter(F.split(c, "[/-]"), lambda p: p != "")


def type_hint(c: Column) -> Column:
    return squeeze(ascii_fold(c))


def _abbreviations(c: Column) -> Column:
    table = F.create_map(*[x for k, v in TYPE_ABBREVIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, type_hint(c)), F.array().cast("array<string>"))


def number_aliases(number: Column, legal_type: Column) -> Column:
    """Every form under which a number may be cited; empty for an empty number."""
    return let(F.struct(normalize_number(number).alias("n"), _abbreviations(legal_type).alias("a")), lambda x: _aliases(x["n"], x["a"]))


def _aliases(n: Column, abbreviations: Column) -> Column:
    parts = number_parts(n)
    base = F.get(parts, F.lit(0))
    forms = F.array(n, F.replace(n, F.lit("-"), F.lit("/")), F.replace(n, F.lit("/"), F.lit("-")))
    bare = F.when((F.size(parts) > 1) & F.element_at(parts, -1).rlike("[a-z]"), F.array(base)).otherwise(F.array().cast("array<string>"))
    short = F.when(base.isNotNull(), F.flatten(F.transform(abbreviations, lambda a: F.array(F.concat(base, F.lit("/"), a), F.concat(base, F.lit("-"), a))))).otherwise(F.array().cast("array<string>"))
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(forms, bare, short)))


def sql_number_aliases(number: Column, legal_type: Column) -> Column:
    """The aliases, those in upper case too, in order: what a store that compares as it stands is asked for."""
    return let(number_aliases(number, legal_type), lambda a: F.array_sort(F.array_distinct(F.concat(a, F.transform(a, F.upper)))))


def references(folded: Column) -> Column:
    """References in folded text: array of struct(begin, end, raw, number, hint), by place; a typed one wins its span."""
    kind = "struct<begin:int,untyped:int,length:int,end:int,raw:string,number:string,hint:string>"
    plain = F.transform(find_all(folded, NUMBER), lambda m: F.struct(m["begin"].alias("begin"), F.lit(1).alias("untyped"), (m["begin"] - m["end"]).alias("length"), m["end"].alias("end"), m["g0"].alias("raw"), normalize_number(m["g0"]).alias("number"), F.lit(None).cast("string").alias("hint")).cast(kind))
    typed = F.transform(find_all(folded, TYPED_NUMBER, (1, 2)), lambda m: F.struct((m["end"] - F.length(m["g1"])).alias("begin"), F.lit(0).alias("untyped"), (-F.length(m["g1"])).alias("length"), m["end"].alias("end"), m["g1"].alias("raw"), normalize_number(m["g1"]).alias("number"), m["g0"].alias("hint")).cast(kind))
    every = F.array_sort(F.filter(F.concat(plain, typed), lambda m: m["number"] != ""))
    key = lambda m: F.struct(m["begin"], m["end"], m["number"])
    return let(every, lambda e: F.filter(e, lambda m, i: F.array_position(F.transform(e, key), key(m)) == i + 1))


def requires_local_context(number: Column) -> Column:
    return number.rlike("|".join(LOCAL_NUMBERS))


def localities(c: Column) -> Column:
    """Names of provinces and cities: ``tinh`` or ``thanh pho`` and up to three plain words."""
    return let(F.regexp_extract_all(ascii_fold(c), F.lit(r"\S+"), F.lit(0)), _localities)


def _localities(t: Column) -> Column:
    def name(i: Column, head: int) -> Column:
        tail = F.slice(t, i + 1 + head, F.lit(3))
        bad = F.transform(tail, lambda w: w.isin(*LOCALITY_STOPWORDS) | ~w.rlike("^[a-z]+$"))
        stop = F.array_position(bad, True)
        kept = F.when(stop > 0, F.slice(tail, F.lit(1), (stop - 1).cast("int"))).otherwise(tail)
        return F.when(F.size(kept) > 0, F.array_join(F.concat(F.slice(t, i + 1, F.lit(head)), kept), " "))

    at = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(at, lambda i: F.when(F.get(t, i) == "tinh", name(i, 1)).when((F.get(t, i) == "thanh") & (F.get(t, i + 1) == "pho"), name(i, 2)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


# -- labels, years, link types ---------------------------------------------------------------------


def article_component(c: Column) -> Column:
    n = F.regexp_extract(ascii_fold(c), ARTICLE, 1)
    return F.when(n != "", F.concat(F.lit("Điều "), n))


def article_labels(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_fold(c), F.lit(r"\bdieu\s+\d+[a-z]?\b"), F.lit(0)))


def reference_label(window: Column) -> Column:
    """The last article of a window with the last clause and point that begin no later than it ends."""
    return let(ascii_fold(window), lambda t: let(F.struct(t.alias("t"), F.try_element_at(find_all(t, ARTICLE, (1,)), F.lit(-1)).alias("a")), lambda x: _label(x["t"], x["a"])))


def _label(t: Column, article: Column) -> Column:
    last = lambda pattern: F.try_element_at(F.filter(find_all(t, pattern, (1,)), lambda m: m["begin"] <= article["end"]), F.lit(-1))["g0"]
    return F.when(article.isNotNull(), F.concat_ws(" ", F.concat(F.lit("Điểm "), last(POINT)), F.concat(F.lit("Khoản "), last(CLAUSE)), F.concat(F.lit("Điều "), article["g0"])))


def reference_year(window: Column) -> Column:
    """The year of the first date in 1800 to 2100; two digits from 40 on are 19xx, else 20xx."""
    found = F.regexp_extract_all(text_or_empty(window), F.lit(r"\b\d{1,2}[/-]\d{1,2}[/-](\d{2,4})\b"), F.lit(1))
    full = F.transform(found, lambda y: F.when(F.length(y) == 2, y.cast("int") + F.when(y.cast("int") >= 40, 1900).otherwise(2000)).otherwise(y.cast("int")))
    return F.get(F.filter(full, lambda y: y.between(1800, 2100)), F.lit(0))


def link_type(window: Column) -> Column:
    """struct(link_type, cue) of a folded window: the first cue in order of weight."""
    kind, cue = None, None
    for name, patterns in LINK_CUES.items():
        for p in patterns:
            hit, text = window.rlike(p), F.regexp_extract(window, p, 0)
            kind = F.when(hit, name) if kind is None else kind.when(hit, name)
            cue = F.when(hit, text) if cue is None else cue.when(hit, text)
    return F.struct(kind.otherwise("cites").alias("link_type"), cue.alias("cue"))


def reference_quote(text: Column, raw: Column, window: int = 140) -> Column:
    """What stands around the first mention of ``raw`` in any case; without one, a summary."""
    t = squeeze(text)
    at = F.instr(F.lower(t), F.lower(raw))
    begin, end = F.greatest(at - 1 - window, F.lit(0)), F.least(at - 1 + F.length(raw) + window, F.length(t))
    cut = F.concat(F.when(begin > 0, F.lit("... ")).otherwise(F.lit("")), strip(F.substring(t, begin + 1, end - begin)), F.when(end < F.length(t), F.lit(" ...")).otherwise(F.lit("")))
    return F.when(t == "", F.lit("")).when((F.length(raw) > 0) & (at > 0), cut).otherwise(summarize(t, min(2 * window, 260)))


def instruction_type(c: Column) -> Column:
    """repeal, amendment, guidance or reference, by the first keyword in that order."""
    told = lambda t: F.when(t.rlike("bai bo|huy bo|thay the"), "repeal").when(t.rlike("sua doi|bo sung|dinh chinh"), "amendment").when(t.rlike("huong dan|quy dinh chi tiet|co hieu luc thi hanh|to chuc thuc hien"), "guidance").otherwise("reference")
    return let(ascii_fold(c), told)


# -- provenance -----------------------------------------------------------------------------------


def document_family(legal_type: Column) -> Column:
    t = ascii_fold(legal_type)
    return F.when(t.isin(*NORMATIVE_TYPES), "normative").when(t.isin(*ADMINISTRATIVE_TYPES), "administrative").otherwise("general")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def issuer_scope(issuer: Column) -> Column:
    return let(ascii_fold(issuer), lambda t: F.when(t == "", "unknown").when(_any(t, LOCAL_ISSUERS), "local").when(_any(t, CENTRAL_ISSUERS), "central").otherwise("unknown"))


def query_value(number: Column, title: Column) -> Column:
    n = strip(text_or_empty(number))
    return F.when((n != "") & (F.length(n) <= 60), n).otherwise(strip(text_or_empty(title)))


def offers_government_portal(issuer: Column, legal_type: Column, number: Column) -> Column:
    n = ascii_fold(number)
    return (issuer_scope(issuer) == "central") | (ascii_fold(legal_type).isin("nghi dinh", "chi thi", "quyet dinh", "nghi quyet") & (n.contains("ttg") | n.contains("cp")))


#: What readers are told of a family and a scope (fixed values): label, headline; label.
FAMILIES = {
    "normative": ("Normative act", "Strong official lookup routes available"),
    "administrative": ("Administrative / guidance record", "Official search routes available"),
    "general": ("General legal record", "Official search fallbacks available"),
}
SCOPES = {"central": "Central issuer", "local": "Local issuer", "unknown": "Issuer scope unknown"}


def _told(c: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def provenance(number: Column, title: Column, legal_type: Column, issuer: Column) -> Column:
    """Family and scope with their labels, a headline, how sure each official source is, and its search address."""
    q = F.url_encode(query_value(number, title))
    family, scope = document_family(legal_type), issuer_scope(issuer)
    return F.struct(
        family.alias("family"),
        scope.alias("scope"),
        _told(family, {k: v[0] for k, v in FAMILIES.items()}).alias("family_label"),
        _told(family, {k: v[1] for k, v in FAMILIES.items()}).alias("headline"),
        _told(scope, SCOPES).alias("scope_label"),
        F.when(family == "normative", "high").otherwise("medium").alias("vbpl_confidence"),
        F.when(offers_government_portal(issuer, legal_type, number), F.when(scope == "central", "high").otherwise("medium")).alias("government_confidence"),
        F.concat(F.lit("https://vbpl.vn/pages/vbpq-timkiem.aspx?type=0&s=1&SearchIn=Title,Title1&Keyword="), q).alias("vbpl_url"),
        F.when(offers_government_portal(issuer, legal_type, number), F.concat(F.lit("https://vanban.chinhphu.vn/?pageid=473&q="), q)).alias("government_url"),
    )
