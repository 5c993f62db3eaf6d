"""A bucket of a versioned table is written by as many tasks as its size asks for."""

from pyspark.sql import functions as F

from lexweave.sources.corpus import VersionedTable


def test_large_bucket(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64k")
    try:
        t = VersionedTable(spark, str(tmp_path / "t"), "id long, value string", ["id"], 1)
        t.replace(spark.range(0, 20000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("value")))
        assert len(list((tmp_path / "t").glob("v-*/bucket_=0/part-*"))) > 4
        t.upsert(spark.createDataFrame([(3, "new"), (20000, "more")], "id long, value string"))
        assert t.read().count() == 20001
        assert [r.value for r in t.read().where("id in (3, 20000)").orderBy("id").collect()] == ["new", "more"]
    finally:
        spark.conf.unset(key)
