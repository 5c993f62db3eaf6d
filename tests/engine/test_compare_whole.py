"""Comparison reads whole texts, and a pair costs no group of its own."""

import random
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexweave.operators import compare, segment
from lexweave.plans import pipeline_queries

DATA = "/root/testdata/sf0.001"


def test_view_has_whole_texts(spark):
    rows = pipeline_queries.view_of(spark, DATA, 4)[0]
    assert rows.where(~F.contains("content", "c1")).isEmpty()


def test_align_without_groups(spark):
    docs = spark.createDataFrame([(1, "Điều 1. a\nĐiều 2. b"), (2, "Điều 1. a"), (3, "")], "id long, content string")
    pairs = spark.createDataFrame([(1, 2), (3, 2), (7, 8)], "left_id long, right_id long")
    got = compare.align(pairs, segment.sections(docs))
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.left_id, r.right_id, r.kind, r.left_anchor or "", r.right_anchor or "") for r in got.collect())
    assert rows == [
        (1, 2, "left-only", "điều-2-1", ""), (1, 2, "matched", "tieu-de", "tieu-de"), (1, 2, "matched", "điều-1-1", "điều-1-1"),
        (3, 2, "matched", "tieu-de", "tieu-de"), (3, 2, "right-only", "", "điều-1-1"),
    ]


def test_clause_diff_is_that_of_full_ratios():
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    r = random.Random(1)
    words = "thue dat dieu khoan quy dinh ve muc phi".split()
    for _ in range(200):
        left, right = ([" ".join(r.choices(words, k=r.randint(2, 6))) for _ in range(r.randint(0, 5))] for _ in range(2))
        free, want = list(range(len(right))), {"unchanged": 0, "changed": 0, "removed": 0}
        for x in left:
            best = max(((ratio(x, right[k]), -k) for k in free), default=(0.0, 0))
            kind = "unchanged" if best[0] >= 0.95 else "changed" if best[0] >= 0.55 else "removed"
            want[kind] += 1
            if kind != "removed":
                free.remove(-best[1])
        assert compare.clause_diff(left, right) == want | {"added": len(free)}


def test_fold_and_articles():
    for s in ("Điều 1", "ȩ́x", "ﬁ①Ａ", " Straße ", "", None, "ΑΣͅ"):
        plain = unicodedata.normalize("NFKD", (s or "").replace("đ", "d").replace("Đ", "D"))
        assert compare.fold(s) == "".join(c for c in plain if not unicodedata.combining(c)).lower().strip()
    for s in ("dieu 1 dieu 2a", "xdieu 3 dieu  44 dieudieu 5", "dieu dieu 6b dieu 7bc", "dieu"):
        assert list(compare._articles(s)) == compare._ARTICLE.findall(s)
