"""Seasonal naive forecasts, refitted at every origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DAY, KEYS, seconds, shift
from ..plans.backtest import forecast_steps, origins


def seasonal_naive(
    df: DataFrame,
    res: int | str,
    days: int | list[int],
    start: str,
    horizon: int,
    stride: int | None = None,
) -> DataFrame:
    """Step ``h`` of an origin repeats the value ``K * ceil(h / K)`` steps back, with ``K`` = steps in ``days`` days.

    Several seasonalities in a list are forecast in one job and told apart by the column ``days``.
    ``K`` is ``days`` times the whole steps of a day, so a step may not be longer than a day.
    The only join is on (component, timestamp), so no component is gathered anywhere.
    """
    res = seconds(res)
    if res > DAY:
        raise ValueError("a seasonal forecast by days needs a step of at most one day")
    steps = forecast_steps(origins(df, res, start, horizon, stride), res, horizon)
    many = isinstance(days, list)
    if many:
        steps = steps.withColumn("days", F.explode(F.array(*[F.lit(d) for d in days])))
    period = (F.col("days") if many else F.lit(days)).cast("bigint") * (DAY // res)
    back = period * F.ceil(F.col("step") / period) * res
    want = steps.withColumn("_src", shift("ts", -back))
    known = df.select(*KEYS, F.col("ts").alias("_src"), F.col("value").alias("yhat"))
    extra = ["days"] if many else []
    return want.join(known, [*KEYS, "_src"], "left").select(*extra, *KEYS, "origin", "step", "ts", "yhat")
