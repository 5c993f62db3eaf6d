import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

VOCAB = [f"w{i:x}" for i in range(2000)]


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    passage = say(60)
    base = [say(120) for _ in range(20)]
    base[4] = say(3000)  # one line
    item, short = say(40), say(14)
    rows = [(i, t + "\n", "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3] + "\n", "en", "s", 1)]  # an exact copy
    rows += [(101, base[4].replace(base[4].split()[1500], "edited", 1) + ".\n", "en", "s", 1)]  # a near copy: all but the edited place is a repeated run
    rows += [(k, f"{base[5].split(' ', 15)[0]} {short}\n", "en", "s", 1) for k in (107, 108)]  # copies too short for a run
    rows += [(102, f"{passage}\n{say(80)}\n", "en", "s", 1), (103, f"{say(80)}\n{passage}\n{say(30)}\n", "en", "s", 1)]
    rows += [(104, f"{say(50)} {item} {say(50)}\n", "en", "s", 1), (105, None, "en", "s", None), (106, "12 34", None, None, 5), (None, say(50), "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), passage


def test_stages(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = set(range(20)) | {102, 103, None}
    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{path}/stage{k}")
            docs = spark.read.parquet(f"{path}/stage{k}")
            seen[name] = ids(docs)
            assert clean <= seen[name]
        else:
            assert {r.doc_id for r in out.collect()} == seen["decontamination"]
    assert 105 not in seen["language_id"] and 106 not in seen["language_id"]
    assert 100 not in seen["line_dedup"]
    assert {107, 108} <= seen["line_dedup"] and 107 in seen["near_dedup"] and 108 not in seen["near_dedup"]
    assert 4 in seen["near_dedup"]
    assert 104 in seen["near_dedup"] and 104 not in seen["decontamination"]
    texts = {r.doc_id: r for r in docs.collect()}
    assert 101 not in texts or ("edited" in texts[101].text and len(texts[101].text.split()) < 50)
    assert passage in texts[102].text and passage not in texts[103].text
    assert all(r.n_chars == len(r.text) for r in texts.values())
    assert ids(p.run(spark, path)) == seen["decontamination"]


def test_empty(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
