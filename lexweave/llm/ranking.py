"""Gapless numbers for rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .durable import durable

#: Rows that one window numbers.
RUN_ROWS = 500
#: Counts of at most so many values are broadcast; beyond, they are joined by a shuffle.
BROADCAST_VALUES = 1_000_000


def number_rows(rows: DataFrame, within: str, order: list[Column], spread: Column, name: str) -> DataFrame:
    """``rows`` (which must be stored) with ``name``: gapless from 0 in each value of ``within``, which must not be null.

    Rows of each value are dealt by the hash ``spread``, and by their place in
    the stored table, into runs of about RUN_ROWS; a run's first number is the
    count of rows in the runs before it. So neither one value nor many equal
    rows gather in one window. The dealt rows are stored, so that all that
    follows sees the same runs.
    """
    sizes = durable(rows.groupBy(within).agg(F.count("*").alias("n_")), "value-counts")
    small = sizes.count() <= BROADCAST_VALUES
    runs = F.greatest(F.ceil(F.col("n_") / RUN_ROWS).cast("long"), F.lit(1))
    placed = rows.withColumn("at_", F.monotonically_increasing_id()).join(F.broadcast(sizes) if small else sizes, within)
    dealt = durable(placed.withColumn("run_", F.pmod(F.xxhash64(spread, "at_"), runs)).drop("n_", "at_"), "dealt-rows")
    counts = dealt.groupBy(within, "run_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(within).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(within, "run_", before.alias("first_"))
    own = F.row_number().over(Window.partitionBy(within, "run_").orderBy(*order)) - 1
    return dealt.withColumn("own_", own).join(first, [within, "run_"]).withColumn(name, F.col("first_") + F.col("own_")).drop("run_", "own_", "first_")
