"""The flagship query: from raw events to the accuracy of a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.durable import stored
from tidewell.models.naive import seasonal_naive
from tidewell.plans.backtest import METRICS, evaluate
from tidewell.plans.preparation import Preparation, prepare

from .base import ev_hour, rounded

START = "20240122"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly sums, outliers, grid, linear fill, six-hour means, seasonal naive backtest, metrics per series."""
    # the prepared series are read several times from here on, so they become a table
    series = stored(prepare(ev_hour(spark, sf).withColumn("row_id", F.lit(0)), Preparation("1h", to="6h", std_dev=4.5)), "flagship")
    fc = seasonal_naive(series, "6h", 1, START, 4)
    return rounded(evaluate(series, fc, "6h", START, 4), *METRICS)
