import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lexweave.llm import ranking, shards
from lexweave.llm.durable import durable


def one_by_one(sizes, n_shards):
    """Brute force: groups by falling size, each to the least-loaded shard."""
    loads = [0] * n_shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


def test_longest_first_against_brute_force():
    rng = random.Random(7)
    for trial in range(300):
        n_shards = rng.randrange(1, 9)
        sizes = [rng.choice([1, 2, 3, 7, 50, 51, 400, rng.randrange(1, 1000)]) for _ in range(rng.randrange(0, 120))]
        if trial % 3 == 0:
            sizes += [rng.randrange(1, 30)] * rng.randrange(0, 500)
        if trial % 5 == 0:
            sizes.append(20_000)
        plan = shards.longest_first(list(Counter(sizes).items()), n_shards)
        loads, taken = [0] * n_shards, {}
        for size, first, n, shard in plan:
            assert first == taken.get(size, 0)
            taken[size] = first + n
            loads[shard] += size * n
        assert taken == Counter(sizes)
        assert loads == one_by_one(sizes, n_shards)


def check(rows, got, n_shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for k, own in by.items():
        assert 0 <= k < n_shards
        assert sorted(r.slot for r in own) == list(range(len(own)))
    loads = [sum(r.size for r in by.get(k, [])) for k in range(n_shards)]
    groups = {}
    for r in got:
        groups.setdefault((r.text_crc32, r.size), []).append(r)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values())
    assert max(loads) - min(loads) <= max(sum(r.size for r in g) for g in groups.values())


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RUN_ROWS", 7)
    rng = random.Random(1)
    texts = ["x" * rng.randrange(1, 400) + str(i) for i in range(150)]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(500, None), (501, ""), (None, "é"), (7, "copy"), (7, "copy"), (7, "copy")]
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, size int, g string")
    got = shards.shard_documents(df).collect()
    check(rows, got, 8)
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    few = shards.shard_documents(df, shards=3).collect()
    check(rows, few, 3)


def test_groups_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(None if g == 3 else f"g{g}", rng.randrange(1, 60)) for g in (rng.choice([0, 1, 2, 3, rng.randrange(400)]) for _ in range(2000))]
    df = spark.createDataFrame(rows, "rank string, bytes int").repartition(5)
    got = shards.assign_shards(df, "rank", "bytes", 4)
    assert got.columns == ["rank", "bytes", "shard"] and got.count() == len(rows)
    groups = Counter()
    for g, n in rows:
        groups[g] += n
    loads = {r["shard"]: r["n"] for r in got.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
    assert [loads.get(k, 0) for k in range(4)] == one_by_one(groups.values(), 4)
    assert got.groupBy("rank").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


def test_equal_rows_are_not_one_window(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RUN_ROWS", 10)
    df = durable(spark.range(400).selectExpr("1 v", "'same' t"), "equal-rows")
    got = ranking.number_rows(df, "v", [F.col("t")], F.xxhash64("t"), "k")
    assert sorted(r.k for r in got.collect()) == list(range(400))


def test_hot_group_and_empty(spark):
    df = spark.range(100).selectExpr("id doc_id", "if(id < 40, 'same text that is long', concat('t', id)) text")
    got = shards.shard_documents(df).collect()
    assert len({r.shard for r in got if r.doc_id < 40}) == 1
    assert shards.shard_documents(df.where("doc_id < 0")).count() == 0
