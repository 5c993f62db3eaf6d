"""Nulls, empty texts, repeated rows, extra columns of any name and empty tables, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexweave.llm import decontaminate, language, licenses, linededup, packing, quality, shards, simhash, token_files

CLASH = (
    "id text_ th key runs kept before behind print hashes lang_pred lang_pred__ score score__ leak_id leak_hash item_id dir up from given far near "
    "licence line rank n_ at_ run_ own_ first_ bytes shard slot seed fp root rep node tile component_id token sig lang_ words hit rest w t size piece start length"
).split()
PATH = public_tokenizers.path("byte_bpe_50k.json")
SAID = "the river that runs from this house to the old mill and on to the sea where no ship has come for many years"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, SAID + " one two three", "en"), (2, None, None), (3, "", "en"), (3, "", "en"), (None, SAID + " four five", "en"), (4, "123 456", "en"), (5, None, "en"), (6, SAID + " one two three", "en"), (6, SAID + " one two three", "en"), (None, None, None)]
    df = spark.createDataFrame([(i, t, g, None, len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "w " * 30), (2, None), (None, SAID)], "item_id short, text string").withColumn("id", F.lit(1))


def tokens(df):
    return packing.pack_documents(df, PATH)


OPERATORS = {
    "decontaminate": lambda d, b, p: decontaminate.decontaminate(d, b),
    "find_leaks": lambda d, b, p: decontaminate.find_leaks(d, b, [F.col("doc_id"), F.col("score"), F.col("text_")], names=("item", "how")),
    "licences": lambda d, b, p: licenses.scan_licences(d, F.concat(F.lit("a/"), F.col("doc_id").cast("string")), [F.col("doc_id"), F.col("dir"), F.col("up")]),
    "packing": lambda d, b, p: tokens(d),
    "token_files": lambda d, b, p: token_files.write_files(d, p, PATH, 2) or token_files.read_documents(d.sparkSession, p),
    "language": lambda d, b, p: language.identify_documents(d),
    "shards": lambda d, b, p: shards.shard_documents(d),
    "shard_rows": lambda d, b, p: shards.assign_shards(d.withColumn("weight", F.lit(3)).drop("shard"), "text", "weight"),
    "simhash": lambda d, b, p: simhash.near_duplicates(d),
    "quality": lambda d, b, p: quality.judge(d),
    "removed_lines": lambda d, b, p: linededup.removed_lines(d),
    "line_dedup": lambda d, b, p: linededup.drop_repeated_lines(d),
}
ROWS = {"decontaminate": 5 + 1, "find_leaks": 4, "removed_lines": None, "line_dedup": None}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(docs, bench, tmp_path, name):
    got = OPERATORS[name](docs, bench, f"file://{tmp_path}/a").collect()
    want = ROWS.get(name, docs.count())
    assert want is None or len(got) == want
    if name == "line_dedup":  # the null id is first and keeps the passage; of later ones the rest stays, as do documents without text
        assert len(got) == 10 and [r.doc_id for r in got if SAID in (r.text or "")] == [None]
    assert OPERATORS[name](docs.where(F.lit(False)), bench, f"file://{tmp_path}/b").count() == 0


def test_no_benchmark(docs, bench):
    assert decontaminate.find_leaks(docs, bench.where(F.lit(False)), [F.col("doc_id")]).count() == 0


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_stage(docs, bench, tmp_path, k):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = pipeline.STAGES[k]
    out = stage(docs.sparkSession, docs, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns
    out.collect()
    assert stage(docs.sparkSession, docs.where(F.lit(False)), str(tmp_path)).count() == 0
