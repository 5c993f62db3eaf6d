"""Connected components of a graph that no single machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .durable import durable


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges`` that has an edge to another; root is the least node reachable.

    Alternating large-star and small-star contraction: each round is two
    aggregations with partial minima and two joins on the same keys. The minima
    are stored before they are joined, so that both sides of a join are plain
    shuffles and adaptive execution can split a hub's neighbours. Every round's
    edges are written to the shared folder. Null ends and loops count as no
    edge; with no edges the result is empty.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, last = durable(now, "edges"), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last or not sign[0]:
            break
        last = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        large = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")), "low-neighbours")
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
