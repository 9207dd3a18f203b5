"""Autoregression on differences: the ``q = 0`` case of ARIMA, fitted by least squares for all components at once."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..model import KEYS, seconds, shift
from ..slices import halo_window, with_halo


def _differenced(d: int):
    """``d``-fold difference of ``value`` along the halo window."""
    w = halo_window()
    out = F.col("value")
    for k in range(1, d + 1):
        out = out + F.lag("value", k).over(w) * F.lit(float((-1) ** k * comb(d, k)))
    return out


def _solve(sums: pd.Series, size: int) -> pd.Series:
    """Least-squares coefficients from the packed upper triangle of the moment matrix of standardised values."""
    upper = np.triu_indices(size)
    out = []
    for s in sums:
        m = np.zeros((size, size))
        m[upper] = s
        m = m + np.triu(m, 1).T
        out.append(np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=1e-12)[0])
    return pd.Series(out)


def _units(df: DataFrame) -> DataFrame:
    """Mean and deviation of every component."""
    stats = df.groupBy(*KEYS).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    return stats.select(*KEYS, "_mean", F.when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(1.0)).alias("_unit"))


def fit_ar(df: DataFrame, res: int | str, p: int = 12, d: int = 1, span: int | None = None) -> DataFrame:
    """Coefficients ``[const, lag 1 .. lag p]`` of every component: ``(ts_id, id, n, coef)``.

    The moments ``sum(x_i * x_j)`` are ordinary partial aggregates, so a component of any length shrinks to one small
    matrix before anything is gathered; only those matrices reach Python. Values are standardised by component first
    and the coefficients stated for the original ones. A component with fewer than ``p + 2`` complete rows has NULL
    coefficients.
    """
    res = seconds(res)
    w = halo_window()
    units = stored(_units(df), "units")  # a row a component
    scaled = df.select(*KEYS, "ts", "value").join(units, KEYS)
    scaled = scaled.select(*KEYS, "ts", ((F.col("value") - F.col("_mean")) / F.col("_unit")).alias("value"))
    z = with_halo(scaled, res, p + d, 0, span).withColumn("_z0", _differenced(d))
    z = z.withColumns({f"_z{k}": F.lag("_z0", k).over(w) for k in range(1, p + 1)}).filter("home")
    terms = [F.lit(1.0), *[F.col(f"_z{k}") for k in range(1, p + 1)], F.col("_z0")]
    z = z.dropna(subset=[f"_z{k}" for k in range(p + 1)])
    size = len(terms)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = z.groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.sum(terms[i] * terms[j]).alias(f"_s{i}_{j}") for i, j in pairs])
    packed = sums.filter(F.col("n") >= p + 2).select(*KEYS, "n", F.array(*[f"_s{i}_{j}" for i, j in pairs]).alias("_s"))

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series) -> pd.Series:
        return _solve(s, size)

    own = packed.select(*KEYS, solve("_s").alias("_c"))
    lags = F.slice("_c", 2, p) if p else F.expr("cast(array() as array<double>)")
    level = F.col("_mean") * (1 - F.aggregate(lags, F.lit(0.0), lambda a, x: a + x)) if d == 0 else F.lit(0.0)
    coef = F.concat(F.array(F.col("_c")[0] * F.col("_unit") + level), lags)
    out = units.join(sums.select(*KEYS, "n"), KEYS, "left").join(own, KEYS, "left")
    return out.select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("_c").isNotNull(), coef).alias("coef"))


def last_values(df: DataFrame, res: int | str, count: int) -> DataFrame:
    """The last ``count`` steps of every component as one small array ``hist`` (oldest first) and their end ``last_ts``.

    ``reason`` says why a component can't be forecast from them: ``short`` (fewer steps) or ``missing`` (NULL among them).
    """
    res = seconds(res)
    ends = df.groupBy(*KEYS).agg(F.max("ts").alias("last_ts"))
    tail = df.join(ends, KEYS).filter(F.col("ts") > shift("last_ts", -count * res))
    per = tail.groupBy(*KEYS, "last_ts").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("_h"))
    per = per.select(*KEYS, "last_ts", F.col("_h.value").alias("hist"))
    reason = F.when(F.size("hist") < count, "short").when(F.exists("hist", lambda x: x.isNull()), "missing")
    return per.withColumn("reason", reason)


def histories(df: DataFrame, res: int | str, count: int, origin_rows: DataFrame) -> DataFrame:
    """Like :func:`last_values`, but before each of many origins (first forecast timestamps) inside the data."""
    res, w = seconds(res), halo_window()
    d = with_halo(df.select(*KEYS, "ts", "value"), res, count, 0)
    d = d.withColumn("hist", F.array(*[F.lag("value", k).over(w) for k in range(count, 0, -1)]))
    d = d.withColumn("_had", F.count(F.lit(1)).over(w.rowsBetween(-count, -1))).filter("home")
    at = origin_rows.select(*KEYS, F.col("origin").alias("ts"))
    reason = F.when(F.col("_had") < count, "short").when(F.exists("hist", lambda x: x.isNull()), "missing")
    return d.join(at, [*KEYS, "ts"]).select(*KEYS, shift("ts", -res).alias("last_ts"), "hist", reason.alias("reason"))


def without_forecast(state: DataFrame, n: int) -> DataFrame:
    """``n`` NULL forecasts for every component with a ``reason``."""
    gone = state.filter("reason is not null").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return gone.select(*KEYS, "last_ts", "_i", F.lit(None).cast("double").alias("yhat"), "reason")


def with_steps(rows: DataFrame, res: int) -> DataFrame:
    """Origin, step and timestamp of forecasts that are numbered by ``_i`` from the end of the data."""
    step = F.col("_i") + 1
    return rows.select(
        *KEYS, shift("last_ts", res).alias("origin"), step.alias("step"), shift("last_ts", step * res).alias("ts"), "yhat", "reason"
    )


def _extend(hist: np.ndarray, coef: np.ndarray, p: int, d: int, n: int) -> np.ndarray:
    """Forecast differences recursively and integrate them back."""
    levels = [np.diff(hist, k) for k in range(d)]
    ends = [lv[-1] for lv in levels]  # last value of every order of difference
    z = list(np.diff(hist, d)[-p:]) if p else []
    out = np.empty(n)
    for i in range(n):
        step = coef[0] + float(np.dot(coef[1:], z[::-1][:p])) if p else coef[0]
        z = [*z[1:], step] if p else z
        for k in range(d - 1, -1, -1):
            ends[k] = ends[k] + step
            step = ends[k]
        out[i] = step
    return out


def forecast_ar(
    df: DataFrame, model: DataFrame, res: int | str, p: int, d: int, n: int, origin_rows: DataFrame | None = None
) -> DataFrame:
    """Forecast ``n`` steps of every component: ``(ts_id, id, origin, step, ts, yhat, reason)``.

    With ``origin_rows`` the forecasts begin at every origin in them, for backtests of any horizon. What reaches Python
    is one row per component and origin: the ``p + d`` values before it and the coefficients. Components without
    enough values, or without coefficients (``unfitted``), get NULL forecasts with a ``reason``.
    """
    res = seconds(res)

    @F.pandas_udf("array<double>")
    def extend(hist: pd.Series, coef: pd.Series) -> pd.Series:
        return pd.Series([_extend(np.asarray(h, dtype=float), np.asarray(c), p, d, n) for h, c in zip(hist, coef)])

    state = last_values(df, res, p + d) if origin_rows is None else histories(df, res, p + d, origin_rows)
    state = state.join(model, KEYS, "left")
    state = state.withColumn("reason", F.coalesce("reason", F.when(F.col("coef").isNull(), "unfitted")))
    good = state.filter("reason is null")
    paths = good.select(*KEYS, "last_ts", F.posexplode(extend("hist", "coef")).alias("_i", "yhat"))
    paths = paths.withColumn("reason", F.lit(None).cast("string"))
    return with_steps(paths.unionByName(without_forecast(state, n)), res)
