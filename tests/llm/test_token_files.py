import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexweave.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 15, 16, 17, 20, 31, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 4096, 10_000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        words = tf.pack(ids, bits)
        assert len(words) * 64 < n * bits + 64 * bits or n == 0
        assert np.array_equal(tf.unpack(words, bits, n), ids)


def test_ids_beyond_the_width():
    with pytest.raises(ValueError):
        tf.pack(np.array([70_000], np.uint32), 16)


def test_whole_integers():
    """Ids of 16 bits are packed at once, to the same bytes as by shifts."""
    ids = np.random.default_rng(1).integers(0, 1 << 16, 1000).astype(np.uint32)
    shifted = sum(int(x) << 16 * k for k, x in enumerate(ids.tolist())).to_bytes(2 * 1024, "little")
    assert tf.pack(ids, 16).astype("<u8").tobytes() == shifted
    assert tf.WHOLE[16] == "<u2" and tf.unpack(tf.pack(ids, 16), 16, 1000).dtype == np.uint32


def test_width():
    assert [tf.bits_for(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(1)
    lengths = [0, 5, 9000, 1, 4096, 70]
    ids = rng.integers(0, 50_257, sum(lengths)).astype(np.uint32)
    file = tf.TokenFile(tf.pack_file([3, None, 5, 6, 7, 8], lengths, ids, 16))
    at = 0
    for k, n in enumerate(lengths):
        assert np.array_equal(file.document(k), ids[at : at + n])
        at += n
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids), 2))
        assert np.array_equal(file.ids(a, b), ids[a:b])
    with pytest.raises(ValueError):
        tf.TokenFile(bytes(100))


def test_documents(spark, tmp_path):
    rng = random.Random(3)
    whole = Tokenizer.from_file(PATH)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "δέλτα"]) for _ in range(rng.randrange(60)))) for i in range(90)]
    rows += [(-5, "below"), (200, None), (201, ""), (None, "lost"), (7, "tie"), (7, "tie")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    tf.write_files(df, f"file://{tmp_path}/t", PATH, 2, file_ids=100)
    got = sorted(tf.read_documents(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    ids = {(i, k): [*whole.encode(t or "", add_special_tokens=False).ids, 2] for k, (i, t) in enumerate(rows)}
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in ids.items())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == [None] + sorted(i for i, _ in rows if i is not None)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    for i in (7, 33, None, 200, 5000):
        own = sorted(x for (d, _), x in ids.items() if d == i)
        assert sorted(r.ids for r in tf.lookup(spark, f"file://{tmp_path}/t", i).collect()) == own
    tf.write_files(df.where("doc_id > 1000"), f"file://{tmp_path}/e", PATH, 2)
    assert tf.read_documents(spark, f"file://{tmp_path}/e").count() == 0


def test_equal_rows_are_dealt_over_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(4000, numPartitions=8).selectExpr("5L doc_id", "'same words here' text")
    tf.write_files(df, f"file://{tmp_path}/t", PATH, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"file://{tmp_path}/t").select("part").distinct().count() > 1
    got = tf.read_documents(spark, f"file://{tmp_path}/t").collect()
    assert sorted(r.start for r in got) == [r.n_tokens * k for k, r in enumerate(got)]
