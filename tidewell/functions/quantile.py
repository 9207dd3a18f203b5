"""Exact grouped quantiles that do not gather a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10000
CELLS = 4096


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """The ``q`` quantile (linear interpolation) of the non-null ``value`` of every group.

    The built-in exact percentile keeps every distinct value of a group in one buffer. Here a mergeable sketch with
    a guaranteed rank error first brackets the wanted ranks (about ``6 / ACCURACY`` of a group). Counting what lies
    below and inside shows whether the bracket holds them; where it doesn't, it becomes the whole range. It is cut into ``CELLS`` cells that are only counted; values are ordered
    exactly in the one or two cells that hold the wanted ranks.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    # sketch error 1 / ACCURACY, plus a margin
    slack = 3.0 / ACCURACY
    bracket = known.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", max(q - slack, 0.0), ACCURACY).alias("_sk_lo"),
        F.percentile_approx("_v", min(q + slack, 1.0), ACCURACY).alias("_sk_hi"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    sketched = known.join(bracket.select(*keys, "_sk_lo", "_sk_hi"), keys).groupBy(*keys)
    found = sketched.agg(
        F.count(F.when(F.col("_v") < F.col("_sk_lo"), 1)).alias("_below"),
        F.count(F.when(F.col("_v") <= F.col("_sk_hi"), 1)).alias("_upto"),
    )
    at = F.lit(q) * (F.col("_n") - 1)
    holds = (F.col("_below") <= F.floor(at)) & (F.ceil(at) < F.col("_upto"))
    bracket = bracket.join(found, keys).select(
        *keys,
        "_n",
        F.when(holds, F.col("_sk_lo")).otherwise(F.col("_min")).alias("_lo"),
        F.when(holds, F.col("_sk_hi")).otherwise(F.col("_max")).alias("_hi"),
    )
    joined = known.join(bracket, keys)
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    below, inside = F.col("_v") < F.col("_lo"), F.col("_v").between(F.col("_lo"), F.col("_hi"))
    # equal values collapse; everything below the bracket becomes one cell, the bracket is cut into equal cells
    width = (F.col("_hi") - F.col("_lo")) / CELLS
    cell = F.when(below, -1).otherwise(
        F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(CELLS - 1))).otherwise(0)
    )
    counted = (
        joined.filter(below | inside)
        .groupBy(*keys, "_n", cell.cast("int").alias("_cell"), F.when(inside, F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    upto = lambda *by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.lit(q) * (F.col("_n") - 1)
    hits = lambda rank: (F.col("_r0") <= rank) & (rank < F.col("_r1"))
    # first the cells that hold the wanted ranks (one row per cell), then the values inside these cells
    cells = (
        counted.groupBy(*keys, "_n", "_cell")
        .agg(F.sum("_c").alias("_cc"))
        .withColumn("_r1", F.sum("_cc").over(upto(*keys, order="_cell")))
        .withColumn("_r0", F.col("_r1") - F.col("_cc"))
        .filter((F.col("_cell") >= 0) & (hits(F.floor(at)) | hits(F.ceil(at))))
        .select(*keys, "_cell", F.col("_r0").alias("_start"))
    )
    ranked = (
        counted.join(cells, [*keys, "_cell"])
        .withColumn("_r1", F.col("_start") + F.sum("_c").over(upto(*keys, "_cell", order="_v")))
        .withColumn("_r0", F.col("_r1") - F.col("_c"))
    )
    out = ranked.groupBy(*keys).agg(
        F.max(F.when(hits(F.floor(at)), F.col("_v"))).alias("_a"),
        F.max(F.when(hits(F.ceil(at)), F.col("_v"))).alias("_z"),
        F.first(at - F.floor(at)).alias("_w"),
    )
    return out.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_w")).alias(name))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_quantile(df, keys, value, 0.5, name)
