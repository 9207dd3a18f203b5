"""Smoothing, null-free fragments, splits, scaling and the wide layout."""

from __future__ import annotations

from datetime import date
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, epoch, floor_div, instant, listed, seconds
from ..slices import SLICE, halo_window, nearest, running_sum, span_of, with_halo


def savgol_table(window: int, order: int) -> np.ndarray:
    """Row ``p``: weights of the ``window`` values for the least-squares polynomial at position ``p``.

    Worked out in fractions, so each weight is the double nearest to it.
    """
    basis: list[list[Fraction]] = []  # orthogonal polynomials at the places of the window
    for degree in range(order + 1):
        own = [Fraction(i - window // 2) ** degree for i in range(window)]
        for q in basis:
            share = sum(a * b for a, b in zip(own, q, strict=True)) / sum(b * b for b in q)
            own = [a - share * b for a, b in zip(own, q, strict=True)]
        basis.append(own)
    sizes = [sum(b * b for b in q) for q in basis]
    return np.array([[float(sum(q[p] * q[j] / n for q, n in zip(basis, sizes, strict=True))) for j in range(window)] for p in range(window)])


def savgol(df: DataFrame, res: int | str, window: int, order: int, span: int | None = None) -> DataFrame:
    """Savitzky-Golay smoothing of a regular grid.

    Inner points use the centred weights; the first and last ``window // 2`` points are read off the polynomial
    through the outermost full window. Components shorter than the window give NULL.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError("window must be odd and larger than the order")
    res, half = seconds(res), window // 2
    weights = savgol_table(window, order)
    ends = df.groupBy(*KEYS).agg(F.min("ts").alias("_k0"), F.max("ts").alias("_k1"))
    w = halo_window()
    d = with_halo(df.select(*KEYS, "ts", "value"), res, window - 1, window - 1, span)
    around = {k: (F.lag("value", -k) if k < 0 else F.lead("value", k)).over(w) for k in range(1 - window, window) if k}
    d = d.withColumns({f"_v{k + window}": c for k, c in around.items()}).withColumn(f"_v{window}", F.col("value"))
    d = d.filter("home").join(ends, KEYS)
    head = floor_div(epoch("ts") - epoch("_k0"), res)
    tail = floor_div(epoch("_k1") - epoch("ts"), res)

    def at(p: int):
        """Smoothed value when the row sits at position ``p`` of its window."""
        return sum((F.col(f"_v{j - p + window}") * float(weights[p][j]) for j in range(window)), F.lit(0.0))

    out = at(half)
    for p in range(half):
        out = F.when(head == p, at(p)).when(tail == p, at(window - 1 - p)).otherwise(out)
    return d.select(*KEYS, "ts", out.alias("value"))


def split_fragments(df: DataFrame, res: int | str, span: int | None = None) -> DataFrame:
    """Cut series into maximal stretches without missing values.

    A series breaks wherever any of its components is missing or a step is absent for all of them. Adds
    ``fragment_id``, counted from 0 along each series.
    """
    res = seconds(res)
    span = span or span_of(res)
    per = df.groupBy("ts_id", "ts").agg(F.bool_or(F.col("value").isNull()).alias("_null"))
    keys = ["ts_id"]
    d = nearest(per, F.lit(True), ["_null"], span, keys)
    whole = ~F.col("_null")
    joined = F.coalesce((F.col("prev.ts") + F.expr(f"interval '{res}' second") == F.col("ts")) & ~F.col("prev._null"), F.lit(False))
    starts = F.when(whole & ~joined, 1).otherwise(0)
    d = d.withColumn("_start", starts).select("ts_id", SLICE, "ts", "_null", "_start")
    d = running_sum(d, F.col("_start"), "_count", span, keys)
    marks = d.filter(~F.col("_null")).select("ts_id", "ts", (F.col("_count") - 1).cast("bigint").alias("fragment_id"))
    return df.join(marks, ["ts_id", "ts"]).select(*df.columns, "fragment_id")


def split(df: DataFrame, val: str, test: str, end: str | None = None) -> DataFrame:
    """Label rows train / val / test by date; ``end`` is the last test day, inclusive.

    When both dates are equal, validation and test are the same rows and appear twice. Dates may be spelt with or
    without dashes; they have to be real and in order.
    """
    days = [date.fromisoformat(x) for x in (val, test, *([] if end is None else [end]))]
    if days != sorted(days):
        raise ValueError(f"dates are not in order: {', '.join(map(str, days))}")
    val, test = str(days[0]), str(days[1])
    end = None if end is None else str(days[2])
    v, t = instant(val), instant(test)
    d = df
    if end is not None:
        d = d.filter(F.col("ts") < instant(end) + F.expr("interval '1' day"))
    if val == test:
        labels = F.when(F.col("ts") < v, F.array(F.lit("train"))).otherwise(F.array(F.lit("val"), F.lit("test")))
        return d.withColumn("split", F.explode(labels))
    return d.withColumn("split", F.when(F.col("ts") < v, "train").when(F.col("ts") < t, "val").otherwise("test"))


def split_info(df: DataFrame, val: str, test: str, end: str | None = None) -> DataFrame:
    """Validation start, test start and last test day of every series."""
    d = split(df, val, test, end)
    return d.groupBy("ts_id").agg(
        F.min(F.when(F.col("split") == "val", F.to_date("ts"))).alias("val_start"),
        F.min(F.when(F.col("split") == "test", F.to_date("ts"))).alias("test_start"),
        F.max(F.to_date("ts")).alias("test_end"),
    )


def fit_minmax(df: DataFrame) -> DataFrame:
    """Smallest and largest training value of every component: ``scaler(ts_id, id, lo, hi)``."""
    d = df.filter(F.col("split") == "train") if "split" in df.columns else df
    return d.groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def scale(df: DataFrame, scaler: DataFrame, value: str = "value") -> DataFrame:
    """``(x - lo) / (hi - lo)``; a constant component gives ``x - lo``, one without a scaler keeps its rows with NULL."""
    width = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return df.join(scaler, KEYS, "left").withColumn(value, (F.col(value) - F.col("lo")) / width).select(*df.columns)


def unscale(df: DataFrame, scaler: DataFrame, value: str = "value") -> DataFrame:
    """Inverse of :func:`scale`."""
    width = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return df.join(scaler, KEYS, "left").withColumn(value, F.col(value) * width + F.col("lo")).select(*df.columns)


def stack(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row per series and timestamp with a column per component in ``ids``.

    A component outside ``ids`` is an error: leave it out beforehand if it isn't wanted.
    """
    return df.withColumn("id", listed("id", ids)).groupBy("ts_id", "ts").pivot("id", ids).agg(F.first("value", ignorenulls=True))


