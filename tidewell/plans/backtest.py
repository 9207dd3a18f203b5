"""Rolling-origin backtests and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, instant, seconds, shift
from ..slices import halo_window, span_of, step_rows, with_halo

METRICS = ["mae", "rmse", "nrmse_min_max", "nrmse_mean", "mape", "mase", "smape"]


def _stride(horizon: int, stride: int | None) -> int:
    stride = horizon if stride in (None, -1) else stride
    if stride > horizon:
        raise ValueError(f"stride {stride} exceeds horizon {horizon}")
    return stride


def origins(df: DataFrame, res: int | str, start: str, horizon: int, stride: int | None = None) -> DataFrame:
    """Forecast origins (first forecast timestamps): from the first timestamp at or after ``start``, every ``stride``
    steps, as long as the whole horizon lies inside the data. Without a stride it equals the horizon."""
    res, stride = seconds(res), _stride(horizon, stride)
    per = df.groupBy(*KEYS).agg(
        F.min(F.when(F.col("ts") >= instant(start), F.col("ts"))).alias("_first"), F.max("ts").alias("_hi")
    )
    per = per.filter("_first is not null").withColumn("_last", shift("_hi", -(horizon - 1) * res))
    rows = step_rows(per, F.col("_first"), F.col("_last"), stride * res, span_of(stride * res), "origin", spread=KEYS)
    return rows.select(*KEYS, "origin")


def forecast_steps(origin_rows: DataFrame, res: int | str, horizon: int) -> DataFrame:
    """One row per origin and step with its timestamp."""
    d = origin_rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return d.withColumn("ts", shift("origin", (F.col("step") - 1) * seconds(res)))


def merge_windows(fc: DataFrame, horizon: int, stride: int | None = None) -> DataFrame:
    """Cover every timestamp once: of overlapping windows the steps ``horizon - stride + 1 .. horizon`` remain."""
    return fc.filter(F.col("step") > horizon - _stride(horizon, stride))


def actual_stats(df: DataFrame, res: int | str, begin: Column, m: int = 1, span: int | None = None) -> DataFrame:
    """Per component: ``lo``, ``hi``, ``mean`` of the values from ``begin`` on, and ``scale``, the mean absolute
    seasonal difference of those before it. One pass over the actual values."""
    earlier = F.abs(F.col("value") - F.lag("value", m).over(halo_window()))
    test = F.when(F.col("ts") >= begin, F.col("value"))
    d = with_halo(df.select(*KEYS, "ts", "value"), seconds(res), m, 0, span).withColumn("_d", earlier).filter("home")
    return d.groupBy(*KEYS).agg(
        F.min(test).alias("_lo"),
        F.max(test).alias("_hi"),
        F.avg(test).alias("_mean"),
        F.avg(F.when(F.col("ts") < begin, F.col("_d"))).alias("scale"),
    )


def component_metrics(
    actual: DataFrame,
    fc: DataFrame,
    res: int | str,
    start: str,
    horizon: int,
    stride: int | None = None,
    m: int = 1,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """All error metrics per component (and per column of ``by``, such as a trial number).

    ``fc`` are merged windows. Errors use the timestamps both sides have; range and mean of the actual values cover
    the whole test span, which begins ``horizon - stride`` steps after ``start``. ``n`` counts the forecasts and
    ``n_missing`` the NULL ones among them; with any of those the metrics are NULL, for a mean over the rest would
    look like that of a complete forecast.
    """
    overlap = horizon - _stride(horizon, stride)
    begin = shift(instant(start), overlap * seconds(res))
    test = actual.select(*KEYS, "ts", F.col("value").alias("y")).filter(F.col("ts") >= begin)
    e = F.col("y") - F.col("yhat")
    size = F.abs("y") + F.abs("yhat")
    whole = lambda c: F.when(F.count("yhat") == F.count("*"), c)
    err = (
        fc.select(*by, *KEYS, "ts", "yhat")
        .join(test, [*KEYS, "ts"])
        .groupBy(*by, *KEYS)
        .agg(
            F.count("*").alias("n"),
            (F.count("*") - F.count("yhat")).alias("n_missing"),
            whole(F.avg(F.abs(e))).alias("mae"),
            whole(F.sqrt(F.avg(e * e))).alias("rmse"),
            whole(F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y"))))).alias("_ape"),
            whole(F.avg(F.when(size != 0, F.abs(e) / size))).alias("_sape"),
            F.min(size).alias("_size"),
            F.min("yhat").alias("_fmin"),
        )
    )
    return err.join(actual_stats(actual, res, begin, m), KEYS, "left").select(
        *by,
        *KEYS,
        "n",
        "n_missing",
        "mae",
        "rmse",
        F.when(F.col("_hi") != F.col("_lo"), F.col("rmse") / (F.col("_hi") - F.col("_lo"))).alias("nrmse_min_max"),
        F.when(F.col("_mean") != 0, F.col("rmse") / F.col("_mean")).alias("nrmse_mean"),
        F.when((F.col("_lo") > 0) & (F.col("_fmin") > 0), 100 * F.col("_ape")).alias("mape"),
        F.when(F.col("scale") != 0, F.col("mae") / F.col("scale")).alias("mase"),
        F.when(F.col("_size") != 0, 200 * F.col("_sape")).alias("smape"),
    )


def metrics_by_series(per_component: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the components of a series; a metric that is undefined for one component stays NULL.

    Only the scaled errors may be undefined for a component (without range or mean) and are then left out; where
    forecasts are missing, they are NULL as well.
    """
    lax = {"nrmse_min_max", "nrmse_mean"}
    one = lambda c: F.when(F.count("rmse" if c in lax else c) == F.count("*"), F.avg(c))
    return per_component.groupBy(*by, "ts_id").agg(*[one(c).alias(c) for c in METRICS])


def metrics_macro(per_series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted mean over series; undefined values are skipped."""
    return per_series.groupBy(*by).agg(*[F.avg(c).alias(c) for c in METRICS])


def eval_target(df: DataFrame, method: str, name: str) -> DataFrame:
    """Choose what is evaluated, by series id (``ts_id``) or by component id (``id``).

    When several series hold the component, the last one by name counts.
    """
    if method == "ts_id":
        return df.filter(F.col("ts_id") == name)
    last = df.filter(F.col("id") == name).agg(F.max("ts_id"))
    return df.filter((F.col("id") == name) & (F.col("ts_id") == last.scalar()))


def evaluate(actual: DataFrame, fc: DataFrame, res, start, horizon, stride=None, m: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Merge the windows and compute the metrics per series."""
    merged = merge_windows(fc, horizon, stride)
    return metrics_by_series(component_metrics(actual, merged, res, start, horizon, stride, m, by), by)
