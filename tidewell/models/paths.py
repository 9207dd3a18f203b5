"""Probabilistic forecasts: bootstrap paths from training residuals and their quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..model import KEYS, seconds, shift
from ..slices import running_sum, span_of
from .ar import histories, last_values
from .trees import LagModel, covariate_features, rounds


def _numbered(residuals: DataFrame, res: int | str) -> tuple[DataFrame, DataFrame]:
    """Known residuals of each component by number, and how many it has."""
    known = residuals.filter("e is not null").select(*KEYS, "ts", "e")
    numbered = running_sum(known, F.lit(1), "_no", span_of(seconds(res))).select(*KEYS, (F.col("_no") - 1).alias("_no"), "e")
    return numbered, known.groupBy(*KEYS).agg(F.count("*").alias("_size"))


def recursive_paths(
    model: LagModel, df: DataFrame, residuals: DataFrame, res: int | str, n: int, samples: int, seed: int = 0,
    origin_rows: DataFrame | None = None, covs: DataFrame | None = None,
) -> DataFrame:
    """``samples`` paths of every component: a training residual is added to each step before it is fed back.

    So errors build up along a path as the model passes them on, and bands widen with the step. The state is one row per component,
    origin and sample; draws are seeded hashes, as in :func:`sample_paths`. Components without residuals, or that can't be forecast,
    have NULL paths.
    """
    res, longest = seconds(res), max(model.lags)
    known = last_values(df, res, longest) if origin_rows is None else histories(df, res, longest, origin_rows)
    numbered, sizes = _numbered(residuals, res)
    each = known.select(*KEYS, "last_ts", "hist", "reason").join(sizes, KEYS, "left").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    each = stored(each, "samples")
    good = each.filter("reason is null and _size is not null")
    draws = good.select(*KEYS, "last_ts", "sample", "_size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_i"))
    draws = draws.withColumn("_no", F.pmod(F.xxhash64(*KEYS, "last_ts", "sample", "_i", F.lit(seed)), F.col("_size"))).join(numbered, [*KEYS, "_no"])
    shocks = draws.groupBy(*KEYS, "last_ts", "sample").agg(F.sort_array(F.collect_list(F.struct("_i", "e")))["e"].alias("shocks"))
    extra = stored(covariate_features(model, covs, res), "covariates") if model.covariates else None
    state = good.drop("reason", "_size").join(shocks, [*KEYS, "last_ts", "sample"])
    state = rounds(model, state, ["sample", "shocks"], res, n, extra, "shocks")
    out = state.select(*KEYS, "last_ts", "sample", F.posexplode(F.slice("path", 1, n)).alias("_i", "yhat"))
    lost = each.filter("reason is not null or _size is null").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = out.unionByName(lost.select(*KEYS, "last_ts", "sample", "_i", F.lit(None).cast("double").alias("yhat")))
    step = F.col("_i") + 1
    return out.select(*KEYS, shift("last_ts", res).alias("origin"), step.alias("step"), shift("last_ts", step * res).alias("ts"), "sample", "yhat")


def sample_paths(fc: DataFrame, residuals: DataFrame, res: int | str, samples: int, seed: int = 0) -> DataFrame:
    """Add a random training residual of the component to every forecast, ``samples`` times.

    Residuals ``(ts_id, id, ts, e)`` are numbered along time; a draw is a seeded hash of its key, so it is the same
    after a retry, and finds its residual by an equi-join on (component, number). A component without residuals keeps
    its forecasts, with NULL paths.
    """
    numbered, sizes = _numbered(residuals, res)
    draws = (
        fc.join(sizes, KEYS, "left")
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("_no", F.pmod(F.xxhash64(*KEYS, "origin", "ts", "sample", F.lit(seed)), F.col("_size")))
    )
    return draws.join(numbered, [*KEYS, "_no"], "left").select(
        *KEYS, "origin", "step", "ts", "sample", (F.col("yhat") + F.col("e")).alias("yhat")
    )


def quantiles(paths: DataFrame, qs: list[float]) -> DataFrame:
    """One column ``q_<percent>`` per quantile; a group holds only the samples of one forecast."""
    d = paths.groupBy(*KEYS, "origin", "step", "ts").agg(F.percentile("yhat", F.array(*[F.lit(q) for q in qs])).alias("_q"))
    return d.select(*KEYS, "origin", "step", "ts", *[F.col("_q")[i].alias(f"q_{round(q * 100)}") for i, q in enumerate(qs)])


