"""Which documents belong to a focused corpus, and which subject a document has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ascii_fold, let, parsed_date, plain_field, slugify, text_or_empty, token_set

# -- fixed values ---------------------------------------------------------------------------------

PRIMARY_ISSUERS = "bo tai chinh|ngan hang nha nuoc|uy ban chung khoan|bo ke hoach va dau tu|bo cong thuong|bo xay dung|bo tai nguyen va moi truong|bo y te|bo thong tin va truyen thong|bo giao thong van tai|bo nong nghiep va phat trien nong thon".split("|")
CONDITIONAL_ISSUERS = "chinh phu|thu tuong chinh phu|quoc hoi|chu tich nuoc|uy ban nhan dan|ubnd|hoi dong nhan dan|hdnd".split("|")
FILTERED_ISSUERS = "bo cong an|bo giao duc va dao tao|bo noi vu|bo quoc phong|bo tu phap".split("|")
EXCLUDED_SECTORS = (
    "noi vu|bo may hanh chinh|chinh quyen dia phuong|can bo cong chuc vien chuc|to chuc bien che|thi dua khen thuong|bao tro xa hoi|nguoi co cong|tre em|binh dang gioi|phong chong te nan|an sinh xa hoi|"
    "tu phap|ho tich|quoc tich|ly lich tu phap|tro giup phap ly|tai chinh hanh chinh su nghiep|tai chinh nha nuoc"
).split("|")
FOCUS_WORDS = (
    "doanh nghiep|co dong|co phan|trach nhiem huu han|sap nhap|hop nhat|mua lai|chuyen doi doanh nghiep|quan tri cong ty|chung khoan|co phieu|trai phieu|niem yet|cong ty dai chung|ngan hang|tin dung|lai suat|ngoai hoi|"
    "bao hiem|tai chinh|dau tu|dau thau|thuong mai|xuat khau|nhap khau|hai quan|thue|le phi|ke toan|kiem toan|bat dong san|nha o|xay dung|dat dai|quyen su dung dat|khu cong nghiep|cum cong nghiep|khu kinh te|dien luc|"
    "nang luong|dau khi|xang dau|khoang san|vien thong|cong nghe thong tin|internet|du lieu|duoc|duoc pham|gia thuoc|kham chua benh|giao thong|van tai|hang hai|hang khong|cang bien|logistics|nong nghiep|lam nghiep|"
    "thuy san|chan nuoi|trong trot|phan bon|bao ve thuc vat|lao dong|viec lam|tien luong|bao hiem xa hoi"
).split("|")
FOCUS_SECTORS = (
    "tai chinh|ngan hang|ke hoach va dau tu|cong thuong|thuong mai|doanh nghiep|thue|hai quan|xay dung|bat dong san|dat dai|moi truong|giao thong van tai|hang hai|hang khong|thong tin va truyen thong|cong nghe|y te|duoc|"
    "nong nghiep|thuy san|lao dong"
).split("|")
PUBLIC_WORDS = (
    "hien phap|bo luat hinh su|to tung hinh su|thi hanh an hinh su|an ninh quoc gia|nghia vu quan su|dan quan tu ve|cong an nhan dan|ho tich|quoc tich|cu tru|ho khau|hon nhan|gia dinh|ly hon|thua ke|nuoi con nuoi|"
    "can bo cong chuc|cong chuc|vien chuc|bo may hanh chinh|chinh quyen dia phuong|thi dua|khen thuong|bao tro xa hoi|nguoi co cong|tre em|binh dang gioi|phong chong te nan|an sinh xa hoi"
).split("|")
FOCUS_TYPES = "luat|phap lenh|nghi dinh|thong tu|thong tu lien tich|quyet dinh|nghi quyet|chi thi".split("|")
ECONOMY_WORDS = (
    "kinh te|kinh doanh|tai chinh|ngan hang|chung khoan|bao hiem|thue|phi|le phi|doanh nghiep|dau tu|dau thau|thuong mai|xuat khau|nhap khau|hai quan|gia ca|gia thi truong|ke toan|kiem toan|tien te|ngoai hoi|thi truong|"
    "cong nghiep|khu cong nghiep|cum cong nghiep|nong nghiep|lam nghiep|ngu nghiep|thuy san|chan nuoi|trong trot|xay dung|bat dong san|nang luong|dien luc|dau khi|khoang san|giao thong|van tai|hang hai|hang khong|"
    "buu chinh|vien thong|cong nghe thong tin|du lich|dich vu|lao dong|viec lam|tien luong"
).split("|")
FOCUS_SUBJECTS = (
    "bao hiem|bat dong san|buu chinh|chung khoan|cong nghe|cong nghiep|dat dai|dau gia|dau thau|dau tu|doanh nghiep|duoc|giao thong|gia|hai quan|hop tac xa|kinh doanh|khoang san|khoa hoc|lao dong|lam nghiep|moi truong|"
    "nang luong|ngan hang|nong nghiep|nha o|quy hoach|tai chinh|tai nguyen|thue|thuong mai|thuy loi|thuy san|vien thong|xay dung|xuat khau|y te"
).split("|")
EXCLUDED_SUBJECTS = (
    "an ninh|bo tro tu phap|can bo|chinh sach xa hoi|chinh quyen dia phuong|cong chuc|giao duc|hon nhan|ho tich|noi vu|quoc phong|quoc tich|thi dua|tre em|tu phap|vien chuc|xay dung phap luat|thi hanh phap luat"
).split("|")

# -- corpus selection -----------------------------------------------------------------------------


def whole_word_hits(field: Column, words: list[str]) -> Column:
    """How many of the phrases stand in the field as whole words."""
    padded = F.concat(F.lit(" "), field, F.lit(" "))
    return let(padded, lambda p: F.size(F.filter(F.array(*[F.lit(f" {w} ") for w in words]), lambda w: F.contains(p, w))))


def is_focus_type(legal_type: Column) -> Column:
    return plain_field(legal_type).isin(*FOCUS_TYPES)


def focus_scores(title: Column, legal_type: Column, issuer: Column, branch: Column, field: Column) -> Column:
    """struct(include, exclude, accepted): the scorecard that decides whether a document is in the focused corpus."""
    tidy = lambda c: F.when(F.trim(text_or_empty(c)) != "", F.trim(c))
    forms = F.struct(plain_field(title).alias("t"), plain_field(legal_type).alias("k"), plain_field(issuer).alias("i"), plain_field(F.concat_ws(" | ", tidy(branch), tidy(field))).alias("s"))
    return let(let(forms, _focus_hits), _scorecard)


def _focus_hits(x: Column) -> Column:
    hay = F.concat_ws(" | ", *[F.when(x[c] != "", x[c]) for c in "tkis"])
    lists = {"primary": ("i", PRIMARY_ISSUERS), "conditional": ("i", CONDITIONAL_ISSUERS), "filtered": ("i", FILTERED_ISSUERS), "barred": ("s", EXCLUDED_SECTORS), "sector": ("s", FOCUS_SECTORS)}
    counts = [whole_word_hits(x[c], words).alias(name) for name, (c, words) in lists.items()]
    return F.struct(x["k"].isin(*FOCUS_TYPES).alias("typed"), *counts, whole_word_hits(hay, FOCUS_WORDS).alias("focus"), whole_word_hits(hay, PUBLIC_WORDS).alias("public"))


def _scorecard(h: Column) -> Column:
    points = lambda test, n: F.when(test, n).otherwise(0)
    has = lambda c: h[c] > 0
    topical = has("sector") | has("focus")
    include = points(has("primary"), 5) + points(has("sector"), F.least(F.lit(4), h["sector"] + 1)) + F.least(F.lit(6), h["focus"] * 2) + points(has("conditional") & topical, 2) + points(h["typed"] & topical, 1)
    exclude = h["public"] * 3 + points(has("filtered"), 4) + F.least(F.lit(6), h["barred"] * 2)

    def verdict(s: Column) -> Column:
        i, e = s["include"], s["exclude"]
        refused = (has("filtered") & (i < 6)) | (has("barred") & (i < 7))
        taken = (has("primary") & (i >= 5) & (i + 1 >= e)) | (has("conditional") & (i >= 4) & (i > e)) | (has("sector") & has("focus") & (i >= e)) | ((i >= 5) & (i > e))
        return F.struct(i.alias("include"), e.alias("exclude"), (~refused & taken).alias("accepted"))

    return let(F.struct(include.alias("include"), exclude.alias("exclude")), verdict)


def is_economy_related(*fields: Column) -> Column:
    hay = ascii_fold(F.concat_ws(" | ", *[text_or_empty(f) for f in fields]))
    return let(hay, lambda h: F.exists(F.array(*map(F.lit, ECONOMY_WORDS)), lambda w: F.contains(h, w)))


def newest_first(date: Column, id_col: Column) -> list[Column]:
    d = parsed_date(date)
    return [F.coalesce(F.year(d), F.lit(0)).desc(), F.coalesce(F.date_format(d, "yyyyMMdd"), F.lit("")).desc(), id_col.desc()]


def select_focused(metadata: DataFrame, content_ids: DataFrame) -> DataFrame:
    """Ids of the focused corpus that have content, newest first."""
    m = metadata.join(content_ids.select("id"), "id", "left_semi")
    kept = m.where(focus_scores(F.col("title"), F.col("loai_van_ban"), F.col("co_quan_ban_hanh"), F.col("nganh"), F.col("linh_vuc"))["accepted"])
    return kept.orderBy(*newest_first(F.col("ngay_ban_hanh"), F.col("id"))).select("id")


def select_recent(metadata: DataFrame, content_ids: DataFrame, existing: DataFrame, needed: int) -> DataFrame:
    """The newest ``needed`` ids with content, not there yet and not about the economy."""
    m = metadata.join(content_ids.select("id"), "id", "left_semi").join(existing.select("id"), "id", "left_anti")
    kept = m.where(~is_economy_related(*[F.col(c) for c in ("title", "loai_van_ban", "co_quan_ban_hanh", "nganh", "linh_vuc")]))
    return kept.orderBy(*newest_first(F.col("ngay_ban_hanh"), F.col("id"))).limit(needed).select("id")


# -- subjects -------------------------------------------------------------------------------------


def is_focused_subject(name: Column) -> Column:
    has = lambda t, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    return let(ascii_fold(name), lambda t: ~has(t, EXCLUDED_SUBJECTS) & has(t, FOCUS_SUBJECTS))


def subjects_from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """(id, name, slug) of the options of a page's selection lists; the option -1 stands for all and is left out."""
    pattern = r'<option value="([^"]+)">([^<]+)</option>'
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("id"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("name"))
    rows = pages.select(F.inline(both)).select("id", F.trim("name").alias("name")).where("id != '-1'").distinct()
    return rows.withColumn("slug", slugify(F.col("name")))


def subject_links(docs: DataFrame, subjects: DataFrame) -> DataFrame:
    """(document_id, subject_id) where the sectors share two words with the subject's name, or its only one.

    Joined on words, not on every pair; a document's sectors are few words.
    """
    words = docs.select(F.col("id").alias("document_id"), F.explode(token_set(F.col("legal_sectors"))).alias("word"))
    names = subjects.select(F.col("id").alias("subject_id"), token_set(F.col("name")).alias("w"))
    keyed = names.select("subject_id", F.explode("w").alias("word"), F.least(F.size("w"), F.lit(2)).alias("need"))
    return words.join(keyed, "word").groupBy("document_id", "subject_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("document_id", "subject_id")
