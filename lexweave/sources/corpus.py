"""Reading raw corpora, and versioned tables that take upserts without a table format."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.text import cut as cut_text, excerpt, normalize_html, normalize_markdown, parsed_date, repair_date, slugify, strip, text_or_empty
from ..operators.segment import source_hash
from ..schemas import CONTENT, METADATA

#: Types that a gazette page may name in its fourth line (fixed values).
GAZETTE_TYPES = (
    "NGHỊ ĐỊNH", "NGHỊ QUYẾT", "QUYẾT ĐỊNH", "THÔNG TƯ", "THÔNG TƯ LIÊN TỊCH", "CHỈ THỊ", "LUẬT", "BỘ LUẬT", "LỆNH", "KẾ HOẠCH", "KẾ HOẠCH HÀNH ĐỘNG", "KẾT LUẬN", "KẾT LUẬN THANH TRA",
    "THÔNG BÁO", "THÔNG BÁO KẾT LUẬN", "THÔNG TRI", "HƯỚNG DẪN", "HƯỞNG DẪN TẠM THỜI", "QUY CHẾ PHỐI HỢP", "BÁO CÁO", "QUY TRÌNH, PHƯƠNG ÁN", "QUY ĐỊNH CỦA BỘ CHÍNH TRỊ", "DECREE", "CIRCULAR", "LAW",
)

#: Fields of a record's hash.
HASHED = ("id", "document_number", "title", "url", "legal_type", "legal_sectors", "issuing_authority", "issuance_date", "signers", "content")


def read_batches(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, skip: int = 0, limit: int | None = None, key: str = "id") -> DataFrame:
    """A Parquet source with only the columns asked for; skip and limit go by ``key``, so that they mean the same on every run.

    Only keys are ordered, and of those only the first ``skip`` + ``limit``;
    the rows are then a range of keys, which the scan filters by.
    """
    rows = spark.read.schema(schema).parquet(path)
    keys = rows.select(key)
    if skip:
        last = keys.orderBy(key).offset(skip - 1).limit(1).first()
        rows = rows.where(F.col(key) > last[0]) if last else rows.limit(0)
    if limit is not None:
        last = rows.select(key).orderBy(key).offset(limit).limit(1).first()
        rows = rows.where(F.col(key) < last[0]) if last else rows
    return rows.select(columns) if columns else rows


def content_of(content: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, content_html) of the asked ids; unknown ones have no row."""
    return longest_content(content.join(ids.select("id"), "id", "left_semi"))


def longest_content(content: DataFrame) -> DataFrame:
    """One row per id, the longest HTML; null and empty ones go. An aggregation with partial results, not a window."""
    kept = content.where(F.length("content_html") > 0)
    return kept.groupBy("id").agg(F.max(F.struct(F.length("content_html").alias("n"), F.col("content_html").alias("h"))).alias("m")).select("id", F.col("m.h").alias("content_html"))


def joined_strict(metadata: DataFrame, content: DataFrame) -> DataFrame:
    """Both sides joined on id; raises where an id is on one side only."""
    both = metadata.join(content, "id", "full_outer")
    sides = [c for c in metadata.columns if c != "id"][0], [c for c in content.columns if c != "id"][0]
    return both.where(F.assert_true(F.col(sides[0]).isNotNull() & F.col(sides[1]).isNotNull(), F.lit("ids differ between metadata and content")).isNull())


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[F.when(F.trim(text_or_empty(p)) != "", F.trim(p)) for p in parts])


def records(metadata: DataFrame, content: DataFrame, last_year: int) -> DataFrame:
    """Documents from the raw columns: those with content, normalised."""
    m = metadata.join(longest_content(content), "id")
    text = lambda c: F.trim(text_or_empty(F.col(c)))
    date = repair_date(F.col("ngay_ban_hanh"), last_year, F.col("so_ky_hieu"), F.col("title"))
    plain = normalize_html(F.col("content_html"))
    return m.select(
        "id", text("so_ky_hieu").alias("document_number"), F.when(text("title") != "", text("title")).otherwise(F.concat(F.lit("Document "), F.col("id").cast("string"))).alias("title"),
        F.lit("").alias("url"), text("loai_van_ban").alias("legal_type"), _joined(F.col("nganh"), F.col("linh_vuc")).alias("legal_sectors"), text("co_quan_ban_hanh").alias("issuing_authority"),
        date["issuance_date"].alias("issuance_date"), date["year"].alias("year"), _joined(F.col("chuc_danh"), F.col("nguoi_ky")).alias("signers"), plain.alias("content"), plain.alias("plain_content"), excerpt(plain).alias("excerpt"), text("nguon_thu_thap").alias("source"),
    )


def read_corpus(spark: SparkSession, metadata: str, content: str, last_year: int) -> DataFrame:
    return records(spark.read.schema(METADATA).parquet(metadata), spark.read.schema(CONTENT).parquet(content), last_year)


def markdown_records(metadata: DataFrame, content: DataFrame, last_year: int, dataset: str = "corpus") -> DataFrame:
    """Documents whose raw columns have their final names already and whose text is Markdown (id, content)."""
    m = metadata.join(content.select("id", "content"), "id")
    date = repair_date(F.col("issuance_date"), last_year, F.col("document_number"), F.col("title"))
    plain = normalize_markdown(F.col("content"))
    text = lambda c: text_or_empty(F.col(c))
    url = text("url")
    return m.select(
        "id", text("document_number").alias("document_number"), F.when(text("title") != "", text("title")).otherwise(F.concat(F.lit("Document "), F.col("id").cast("string"))).alias("title"), url.alias("url"),
        text("legal_type").alias("legal_type"), text("legal_sectors").alias("legal_sectors"), text("issuing_authority").alias("issuing_authority"), date["issuance_date"].alias("issuance_date"), date["year"].alias("year"), text("signers").alias("signers"),
        text("content").alias("content"), plain.alias("plain_content"), excerpt(plain).alias("excerpt"), F.when(url != "", url).otherwise(F.lit(dataset)).alias("source"),
    )


#: First line of a gazette page, and the line with number and date (fixed patterns).
MASTHEAD = r"(?iu)^(.+?)\s*\|\s*CỘNG HÒA\s*XÃ HỘI\s*CHỦ NGHĨA\s*VIỆT\s*NAM\s*Độc lập\s*-\s*Tự do\s*-\s*Hạnh phúc\s*$"
NUMBERED = r"^Số\s*:\s*.+?\s*\|\s*.+?,\s*ngày\s+(\d+)\s*tháng\s+(\d+)\s*năm\s+(\d+)$"


def gazette_records(pages: DataFrame, dataset: str = "corpus") -> DataFrame:
    """Documents read from gazette pages (id, raw) by the place of their lines: issuer, number and date, type, title."""
    lines = F.filter(F.transform(F.split(text_or_empty(F.col("raw")), "\n"), strip), lambda x: x != "")
    line = lambda k: F.get("lines", F.lit(k))
    cut = pages.withColumn("lines", lines).withColumn("dated", F.get(F.filter(F.slice("lines", 2, 7), lambda x: x.rlike(NUMBERED)), F.lit(0)))
    issuer = F.when(line(0).rlike(MASTHEAD), F.trim(F.regexp_extract(line(0), MASTHEAD, 1))).otherwise(F.substring(F.coalesce(line(0), F.lit("")), 1, 200))
    part = lambda k, n: F.lpad(F.regexp_extract("dated", NUMBERED, k), n, "0")
    date = F.when(F.col("dated").isNotNull(), F.concat_ws("/", part(1, 2), part(2, 2), F.regexp_extract("dated", NUMBERED, 3))).otherwise(F.lit(""))
    number = F.when(F.col("dated").isNotNull(), strip(F.replace(F.split("dated", r"\|")[0], F.lit("Số:"), F.lit("")))).otherwise(F.lit(""))
    n = F.size("lines")
    named = F.when(n > 5, line(5)).when(n > 4, line(4)).when(n > 1, F.substring(line(1), 1, 200)).otherwise(F.concat(F.lit("Document "), F.col("id").cast("string")))
    kind = F.when(line(3).rlike(rf"(?iu)^(?:{'|'.join(GAZETTE_TYPES)})\b"), F.upper(F.regexp_extract(line(3), rf"(?iu)^({'|'.join(GAZETTE_TYPES)})\b", 1))).otherwise(F.substring(F.coalesce(line(3), F.lit("")), 1, 100))
    plain = normalize_markdown(F.col("raw"))
    rows = cut.select("id", "raw", "lines", issuer.alias("issuing_authority"), number.alias("document_number"), date.alias("issuance_date"), kind.alias("legal_type"), named.alias("t"), plain.alias("plain_content"))
    title = F.when((F.col("t") == F.col("issuing_authority")) & (F.size("lines") > 6), line(6)).otherwise(F.col("t"))
    return rows.select(
        "id", "document_number", cut_text(title, 500).alias("title"), F.lit("").alias("url"), "legal_type", F.lit("").alias("legal_sectors"), "issuing_authority", "issuance_date", F.year(parsed_date(F.col("issuance_date"))).alias("year"), F.lit("").alias("signers"),
        F.col("raw").alias("content"), "plain_content", excerpt(F.col("plain_content")).alias("excerpt"), F.lit(dataset).alias("source"),
    )


class VersionedTable:
    """A Parquet table in buckets of its key, each replaced as a whole; a manifest names the folder of every bucket.

    An upsert rewrites only the buckets that its rows fall into. A new manifest
    appears by a rename under the next number, so that a writer that fails
    leaves the table as it was, and of two writers at once one is told so.
    Readers of the version before are not disturbed; older folders go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str = "") -> list[str]:
        fs, path = self._fs(name)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n.split("-")[1]) for n in self._names() if n.startswith("manifest-"))

    def _manifest(self, number: int) -> dict[str, str]:
        """Bucket -> folder."""
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{number}").collect()))

    def version(self) -> int | None:
        numbers = self._manifests()
        return numbers[-1] if numbers else None

    def _folders(self) -> dict[str, str]:
        version = self.version()
        return {} if version is None else self._manifest(version)

    def _read(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}/bucket_={k}" for k, f in sorted(folders.items())])

    def read(self) -> DataFrame:
        return self._read(self._folders())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _publish(self, folders: dict[str, str]) -> None:
        old = self._manifests()
        number = (old[-1] if old else 0) + 1
        fs, tmp = self._fs(f"writing-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(f"manifest-{number}")[1]):
            fs.delete(tmp, False)
            raise RuntimeError(f"another writer has published version {number} of {self.path}")
        used = set(folders.values()) | (set(self._manifest(old[-1]).values()) if old else set())
        for name in self._names():
            gone = name.startswith("v-") and name not in used or name.startswith("manifest-") and int(name.split("-")[1]) < number - 1
            if gone:
                fs.delete(self._fs(name)[1], True)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket that has rows. Adaptive execution deals a large bucket to several tasks, each of which writes a file."""
        version = f"v-{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([], self.schema).columns
        rows.select(names).withColumn("bucket_", self._bucket()).hint("rebalance", "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{version}")
        return {n.split("=")[1]: version for n in self._names(version) if n.startswith("bucket_=")}

    def replace(self, rows: DataFrame) -> None:
        self._publish(self._write(rows))

    def upsert(self, rows: DataFrame) -> None:
        """Rows of the same key are replaced, others stay; doing it twice is doing it once."""
        new = rows.dropDuplicates(self.key).select(self.spark.createDataFrame([], self.schema).columns)
        self._change(new.select(*self.key), new)

    def delete(self, keys: DataFrame) -> None:
        self._change(keys.select(self.key).distinct(), None)

    def _change(self, keys: DataFrame, new: DataFrame | None) -> None:
        touched = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # at most ``buckets`` numbers
        if not touched:
            return
        folders = self._folders()
        kept = self._read({k: f for k, f in folders.items() if k in touched}).join(keys, self.key, "left_anti")
        written = self._write(kept if new is None else kept.unionByName(new))
        self._publish({k: f for k, f in folders.items() if k not in touched} | written)


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` with source_hash, without the rows whose hash is known."""
    hashed = new.withColumn("source_hash", source_hash(*HASHED))
    known = old.select("id", F.col("source_hash").alias("known_hash"))
    return hashed.join(known, "id", "left").where(~F.col("source_hash").eqNullSafe(F.col("known_hash"))).drop("known_hash")


def repaired_dates(docs: DataFrame, last_year: int) -> DataFrame:
    """Only the rows whose date or year changes when it is normalised again."""
    new = repair_date(F.col("issuance_date"), last_year, F.col("document_number"), F.col("title"))
    told = docs.withColumn("n", new)
    return told.where(~F.col("n.issuance_date").eqNullSafe(F.col("issuance_date")) | ~F.col("n.year").eqNullSafe(F.col("year"))).withColumns({"issuance_date": F.col("n.issuance_date"), "year": F.col("n.year")}).drop("n")


def latest_rows(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def ensure(table: VersionedTable, build: Callable[[], DataFrame]) -> None:
    """Build a derived table when it is not there or empty."""
    if table.read().isEmpty():
        table.replace(build())


# -- selections, revisions and places --------------------------------------------------------------


def save_selection(ids: DataFrame, path: str) -> None:
    """Keep the ids of a selection, in their order."""
    ids.select("id").write.mode("overwrite").json(path)


def load_selection(spark: SparkSession, path: str) -> DataFrame:
    """The ids of a kept selection; none where there is no readable one."""
    try:
        return spark.read.schema("id long").json(path).where("id is not null")
    except AnalysisException:
        return spark.createDataFrame([], "id long")


def metadata_of(metadata: DataFrame, ids: DataFrame) -> DataFrame:
    """The metadata of the selected ids; of several rows of one id the last in the table counts."""
    chosen = metadata.withColumn("at_", F.monotonically_increasing_id()).join(ids.select("id").distinct(), "id", "left_semi")
    return chosen.groupBy("id").agg(F.max_by(F.struct(*[c for c in metadata.columns if c != "id"]), "at_").alias("m")).select("id", "m.*")


def revision(rows: Callable[[], DataFrame], *columns: str) -> str:
    """A name for the state of a table: a hash of its row count and the sums of number columns; empty if it cannot be read."""
    try:
        row = rows().agg(F.count("*"), *[F.sum(c) for c in columns]).first()
    except AnalysisException:
        return ""
    return hashlib.sha256(":".join(str(x) for x in row).encode()).hexdigest()


def cache_folder(root: str) -> str:
    """Where raw files are kept below ``root``."""
    return f"{root.rstrip('/')}/cache"


def content_cache(root: str, dataset: str) -> str:
    """Where a dataset's content table is kept."""
    return f"{cache_folder(root)}/{dataset.strip().replace('/', '--')}/content"


def seed_subjects(spark: SparkSession, path: str, url: str = "") -> DataFrame:
    """(id, name, slug, source, source_url) of a seed file with a JSON list of id and name."""
    rows = spark.read.schema("id string, name string").option("multiLine", True).json(path)
    return rows.select("id", "name", slugify(F.col("name")).alias("slug"), F.lit("seed").alias("source"), F.lit(url).alias("source_url"))


def subjects_or_seed(live: Callable[[], DataFrame], seed: DataFrame) -> DataFrame:
    """The live subjects, or the seed where they cannot be read or there are none."""
    try:
        rows = live()
        return seed if rows.isEmpty() else rows
    except (AnalysisException, OSError):
        return seed


def bootstrap_taxonomy(table: "VersionedTable", links: "VersionedTable", subjects: DataFrame, docs: DataFrame) -> DataFrame:
    """Upsert the subjects and link the documents to them anew."""
    from ..operators.selection import subject_links

    table.upsert(subjects)
    links.replace(subject_links(docs, subjects.select("id", "name")))
    return subjects


def reset(documents: "VersionedTable", dependent: list["VersionedTable"]) -> None:
    """Empty the documents and what hangs on them; subjects, views and the run log stay."""
    for table in (*dependent, documents):
        table.replace(table.read().limit(0))
