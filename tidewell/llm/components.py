"""Connected components of a table of edges by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.durable import stored


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id on an edge the smallest id that it reaches.

    Each round links the larger neighbours of a node to its smallest one, then the same among what lies below a node.
    The number of rounds grows with the logarithm of the longest path. Every round is a table in the shared folder, so
    a lost executor repeats one round at most; nothing but a count and a checksum reaches the driver.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = stored(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        before, state, now = state, _state(then), then
        if state == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
