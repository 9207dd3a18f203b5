"""Calendar columns, holiday flags, cyclic encodings and time covariates; projections only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, col, epoch

# Periods of the cyclic pairs.
PERIODS = {"month": 12, "weekday": 7, "monthday": 30, "yearday": 365, "hour": 24, "yearweek": 52.1428}
COVARIATE_PERIODS = {"month": 12, "day_of_year": 365, "hour": 24, "day_of_week": 7, "week_of_year": 52}


def fields(ts: Column | str = "ts") -> dict[str, Column]:
    """Calendar fields of a timestamp; Monday is weekday 0, days and weeks count from 0."""
    ts = col(ts)
    weekday = F.weekday(ts)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "yearweek": F.weekofyear(ts) - 1,
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
        "weekday": weekday,
        "monthday": F.dayofmonth(ts) - 1,
        "yearday": F.dayofyear(ts) - 1,
        "is_weekend": F.when(weekday >= 5, 1).otherwise(0),
        "epoch": epoch(ts),
    }


def with_holidays(df: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """Add ``holiday`` (0/1) from ``holidays(date)`` or, per component or series, ``holidays(id | ts_id, date)``."""
    if holidays is None:
        return df.withColumn("holiday", F.lit(0))
    on = [c for c in ("ts_id", "id") if c in holidays.columns]
    days = holidays.select(*on, F.col("date").cast("date").alias("_date")).distinct().withColumn("_h", F.lit(1))
    d = df.withColumn("_date", F.to_date("ts")).join(days, [*on, "_date"], "left")
    return d.select(*df.columns, F.coalesce("_h", F.lit(0)).alias("holiday"))


def calendar(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """All calendar columns next to the data, plus ``holiday`` and the week and day positions.

    The weekend is Saturday and Sunday.
    """
    d = with_holidays(df, holidays).withColumns(fields())
    return day_position(week_position(d))


def week_position(df: DataFrame) -> DataFrame:
    """``wn``: weekday + fraction of the day; a holiday counts as Sunday, a Friday holiday as Saturday."""
    day = F.weekday("ts")
    shown = F.when(F.col("holiday") == 1, F.when(day == 4, 5).otherwise(6)).otherwise(day)
    return df.withColumn("wn", shown + F.hour("ts") / F.lit(24.0) + F.minute("ts") / F.lit(1440.0))


def day_position(df: DataFrame) -> DataFrame:
    """``dn``: hour + minute / 60."""
    return df.withColumn("dn", F.hour("ts") + F.minute("ts") / F.lit(60.0))


def cyclical(df: DataFrame) -> DataFrame:
    """Sine and cosine of the calendar fields; ``yearweek`` uses the day of the year with period 52.1428."""
    f = fields()
    source = {**f, "yearweek": f["yearday"]}
    cols = {}
    for name, period in PERIODS.items():
        angle = source[name] * F.lit(2 * math.pi / period)
        cols[f"{name}_sin"] = F.sin(angle)
        cols[f"{name}_cos"] = F.cos(angle)
    return df.withColumns(cols)


def time_covariates(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """The twelve time covariates in long form ``(ts_id, id, ts, value)``, one set per series.

    ``id`` is ``<name>_<ts_id>``. Fields count from 0 with the periods 12, 365, 24, 7 and 52.
    """
    stamps = df.select("ts_id", "ts").distinct()
    d = with_holidays(stamps, holidays)
    f = fields()
    zero_based = {
        "month": f["month"] - 1,
        "day_of_year": f["yearday"],
        "hour": f["hour"],
        "day_of_week": f["weekday"],
        "week_of_year": f["yearweek"],
    }
    cols = {"year": f["year"].cast("double")}
    for name, x in zero_based.items():
        angle = x * F.lit(2 * math.pi / COVARIATE_PERIODS[name])
        cols[f"{name}_sin"] = F.sin(angle)
        cols[f"{name}_cos"] = F.cos(angle)
    cols["holiday"] = F.col("holiday").cast("double")
    wide = d.select("ts_id", "ts", *[c.alias(n) for n, c in cols.items()])
    long = wide.unpivot(["ts_id", "ts"], list(cols), "name", "value")
    return long.select("ts_id", F.concat_ws("_", "name", "ts_id").alias("id"), "ts", "value")


def add_future_covariates(covs: DataFrame, series: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Append the time covariates of every series to its given future covariates."""
    return covs.select(*KEYS, "ts", "value").unionByName(time_covariates(series, holidays))
