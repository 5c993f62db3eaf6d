"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one where that is unset in local mode (tests).

    On a cluster without that setting this is an error: executors would each
    write to a disk of their own.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or f"file://{tempfile.mkdtemp(prefix='lexweave-')}"
        _roots[app] = f"{base.rstrip('/')}/lexweave-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may have gone before
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without running ``df`` again, and reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_like(df: DataFrame, *names: str) -> list[str]:
    """Names that start like ``names`` but clash with no column of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
