"""Feature attribution: window samples, background values and sampled Shapley values."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantile import exact_median
from ..model import KEYS, epoch, seconds
from ..slices import halo_window, with_halo


DIGITS, BUCKETS = 12, 1 << 12


def _windows(df: DataFrame, res: int, length: int) -> DataFrame:
    """All complete windows of ``length`` values, keyed by their first timestamp."""
    w = halo_window().rowsBetween(0, length - 1)
    d = with_halo(df.select(*KEYS, "ts", "value"), res, 0, length - 1).withColumn("steps", F.collect_list("value").over(w))
    return d.filter(F.col("home") & (F.size("steps") == length)).select(*KEYS, "ts", "steps")


def window_dataset(
    df: DataFrame,
    res: int | str,
    length: int,
    horizon: int,
    past: DataFrame | None = None,
    future: DataFrame | None = None,
    size: int | float | None = None,
    seed: int = 0,
) -> DataFrame:
    """Sliding windows over the test set: ``steps`` (target), ``past`` and ``future`` arrays and the start ``epoch``.

    Past covariates reach ``length + horizon`` steps, future ones ``length + 2 * horizon``; they are maps from
    covariate id to values. Windows that cannot be completed are left out. ``size`` is the number of windows wanted
    of each series or, below 1, their share; None means all. Samples are those of the smallest md5 of seed and key.
    """
    res = seconds(res)
    out = _windows(df, res, length)
    for name, cov, reach in (("past", past, length + horizon), ("future", future, length + 2 * horizon)):
        if cov is not None:
            per = _windows(cov, res, reach).select("ts_id", "ts", F.struct("id", "steps").alias("_e"))
            maps = per.groupBy("ts_id", "ts").agg(F.map_from_entries(F.collect_list("_e")).alias(name))
            out = out.join(maps, ["ts_id", "ts"])
    out = out.withColumn("epoch", epoch("ts"))
    if size is None:
        return out
    mark = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *KEYS, F.col("epoch").cast("string"))), 1, DIGITS)
    out = out.withColumn("_key", F.conv(mark, 16, 10).cast("bigint"))
    if isinstance(size, float):
        return out.filter(F.col("_key") < F.lit(round(size * 16**DIGITS))).drop("_key")
    return bottom(out, ["ts_id"], size, ["_key", *KEYS, "ts"]).drop("_key")


def bottom(rows: DataFrame, group: list[str], n: int, order: list[str]) -> DataFrame:
    """The ``n`` first rows of each group by ``order``, whose first column is a hash below 16 ** DIGITS.

    Counts by bucket of the hash (partial sums, ``BUCKETS`` rows a group at most) say in which bucket the last wanted row lies; only
    rows up to that bucket are ordered, about n and one row in ``BUCKETS``. No task sees a whole group, however large n is.
    """
    width = 16**DIGITS // BUCKETS
    bucket = F.call_function("div", F.col(order[0]), F.lit(width)).alias("_bucket")
    counts = rows.select(*group, bucket).groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("_n")
    cut = counts.withColumn("_before", before).filter(F.col("_before") < n).groupBy(*group).agg(((F.max("_bucket") + 1) * width).alias("_cut"))
    few = rows.join(cut, group).filter(F.col(order[0]) < F.col("_cut")).drop("_cut")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def background(train: DataFrame, covs: DataFrame | None = None) -> DataFrame:
    """Stand-in values for masked features: per component the median over series of the training medians, per
    covariate its own median. Result ``(kind, id, value)``."""
    per = exact_median(train, KEYS, "value", "_m")
    out = exact_median(per, ["id"], "_m", "value").select(F.lit("target").alias("kind"), "id", "value")
    if covs is not None:
        med = exact_median(covs, ["id"], "value", "value").select(F.lit("covariate").alias("kind"), "id", "value")
        out = out.unionByName(med)
    return out


def step_columns(windows: DataFrame, length: int) -> DataFrame:
    """Windows with one column ``step_<i>`` per value."""
    return windows.select(*KEYS, "ts", "epoch", *[F.col("steps")[i].alias(f"step_{i}") for i in range(length)])


def attribute(model, rows: DataFrame, inputs: list[str], base: dict[str, float] | Column, perms: int = 8, seed: int = 0) -> DataFrame:
    """Shapley values by sampled permutations, as one batch prediction.

    ``rows`` hold a unique ``row_key`` and the input columns; ``base`` gives the value of a masked feature. For every
    row and permutation the features are switched from base to their own values one after the other. Each
    prediction counts plus for the feature switched on last and minus for the one switched on next, so no ordering of
    predictions is needed. ``model.predict_vectors`` adds ``yhat`` to a ``features`` vector.
    """
    f = len(inputs)
    own = F.array(*[F.col(c).cast("double") for c in inputs])
    masked = F.array(*[F.lit(float(base[c])) for c in inputs])
    draws = rows.select("row_key", own.alias("_x")).withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    # rank of every feature in the permutation, by a seeded hash
    keyed = F.transform(
        F.sequence(F.lit(0), F.lit(f - 1)),
        lambda i: F.struct(F.xxhash64("row_key", "_perm", i, F.lit(seed)).alias("h"), i.alias("i")),
    )
    order = F.transform(F.array_sort(keyed), lambda s: s["i"])
    masks = (
        draws.withColumn("_order", order)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(f))))
        .withColumn("_on", F.when(F.col("_k") > 0, F.slice("_order", F.lit(1), F.greatest("_k", F.lit(1)))).otherwise(F.array().cast("array<int>")))
        .withColumn("_base", masked)
        .withColumn(
            "_mix",
            F.transform("_x", lambda v, i: F.when(F.array_contains("_on", i), v).otherwise(F.element_at("_base", i + 1))),
        )
    )
    spread = masks.select(
        "row_key",
        F.when(F.col("_k") > 0, F.element_at("_order", F.greatest("_k", F.lit(1)))).alias("_gain"),
        F.when(F.col("_k") < f, F.element_at("_order", F.least(F.col("_k") + 1, F.lit(f)))).alias("_loss"),
        array_to_vector("_mix").alias("features"),
    )
    scored = model.predict_vectors(spread)
    signed = F.array(
        F.struct(F.col("_gain").alias("i"), F.col("yhat").alias("v")), F.struct(F.col("_loss").alias("i"), (-F.col("yhat")).alias("v"))
    )
    parts = scored.select("row_key", F.explode(signed).alias("_s")).filter("_s.i is not null")
    names = F.array(*[F.lit(c) for c in inputs])
    return parts.groupBy("row_key", F.element_at(names, F.col("_s.i") + 1).alias("feature")).agg(
        (F.sum("_s.v") / perms).alias("attribution")
    )


def top_features(attributions: DataFrame, n: int = 20) -> DataFrame:
    """Features by mean absolute attribution, the largest ``n``."""
    per = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    return per.orderBy(F.desc("importance"), "feature").limit(n)
