"""Resampling to a coarser resolution, with bins anchored at midnight of the component's first day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DAY, KEYS, epoch, floor_div, from_epoch, seconds
from .profile import infer_resolution

METHODS = ("averaging", "summation", "downsampling")


def coarser(source: int | str, target: int | str) -> None:
    """Raise unless a step of ``target`` is at least one of ``source``."""
    if seconds(target) < seconds(source):
        raise ValueError(f"{target} is finer than {source}: resampling goes to coarser steps only")


def resample(df: DataFrame, res: int | str, method: str = "averaging", source: int | str | None = None) -> DataFrame:
    """Aggregate to bins of ``res``, which may not be finer than the steps of the data.

    ``source`` is the step of the data where it is known; otherwise the smallest one is inferred, which reads the timestamps once.

    averaging: mean of the known values, NULL if there are none; summation: NULL as soon as one value of the bin is
    missing; downsampling: the first known value. When ``res`` divides a day, the midnight anchor is the same
    for all components and no look-up of the first day is needed.
    """
    step = source if source is not None else infer_resolution(df).agg(F.min("seconds")).first()[0]
    if step is not None:
        coarser(step, res)
    res = seconds(res)
    if DAY % res == 0:
        d = df.withColumn("_bin", floor_div(epoch("ts"), res) * res)
    else:
        day0 = df.groupBy(*KEYS).agg((floor_div(epoch(F.min("ts")), DAY) * DAY).alias("_day0"))
        since = epoch("ts") - F.col("_day0")
        d = df.join(day0, KEYS).withColumn("_bin", F.col("_day0") + floor_div(since, res) * res)
    value = {
        "averaging": F.avg("value"),
        "summation": F.when(F.count("value") == F.count("*"), F.sum("value")),
        "downsampling": F.min_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))),
    }[method]
    return d.groupBy(*KEYS, "_bin").agg(value.alias("value")).select(*KEYS, from_epoch("_bin").alias("ts"), "value")
