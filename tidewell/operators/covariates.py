"""Covariate preparation and everything that aligns tables on time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, all_of, instant, listed, seconds, shift
from ..slices import halo_window, with_halo
from .clean import filter_years, to_grid
from .impute import impute
from .resample import resample


def attach_covariates(target: DataFrame, covs: DataFrame, ids: list[str], by: str = "id") -> DataFrame:
    """Left-join covariates, one column per name in ``ids``, to the target on series and time.

    ``by`` is the column of ``covs`` that holds the names; a name outside ``ids`` is an error.
    """
    wide = covs.withColumn(by, listed(by, ids)).groupBy("ts_id", "ts").pivot(by, ids).agg(F.first("value", ignorenulls=True))
    return target.join(wide, ["ts_id", "ts"], "left")


def prepare_covariates(
    df: DataFrame, res: int | str, lo: int | None = None, hi: int | None = None, to: int | str | None = None, method="averaging"
) -> DataFrame:
    """Year filter, regular grid, linear fill and, when ``to`` is coarser, resampling."""
    d = filter_years(df, lo, hi) if lo is not None else df
    filled = impute(to_grid(d, res, keep_slice=True), res, "linear")
    return filled if to is None or seconds(to) == seconds(res) else resample(filled, to, method, res)


def combine(a: DataFrame, b: DataFrame, sign: str = "+") -> DataFrame:
    """Add or subtract two tables on their common timestamps, series by series.

    A second table of one component applies to every component of its series, otherwise components meet by name.
    """
    per = b.groupBy("ts_id").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    other = b.join(per, "ts_id").select(*KEYS, "ts", (F.col("_lo") == F.col("_hi")).alias("_one"), F.col("value").alias("_b"))
    own = a.select(*KEYS, "ts", "value")
    # two equi-joins: no timestamp ever holds more pairs than the result
    named = own.join(other.filter("not _one").drop("_one"), [*KEYS, "ts"])
    shared = own.join(other.filter("_one").select("ts_id", "ts", "_b"), ["ts_id", "ts"])
    out = F.col("value") + F.col("_b") if sign == "+" else F.col("value") - F.col("_b")
    return named.unionByName(shared).select(*KEYS, "ts", out.alias("value"))


def stitch(base: DataFrame, newer: DataFrame) -> DataFrame:
    """Keep ``base`` and append the rows of ``newer`` that follow its last timestamp, per component."""
    last = base.groupBy(*KEYS).agg(F.max("ts").alias("_last"))
    tail = newer.join(last, KEYS, "left").filter(F.col("_last").isNull() | (F.col("ts") > F.col("_last")))
    return base.select(*KEYS, "ts", "value").unionByName(tail.select(*KEYS, "ts", "value"))


def shift_ranges(df: DataFrame, res: int | str, ranges: list[tuple[str | None, str | None, int]]) -> DataFrame:
    """On a regular grid: shift the values inside date ranges by whole steps, one range after the other.

    A range is ``(start, end, steps)`` with inclusive ISO timestamps or None for open ends; a date as end means the
    whole day. What would come from outside the range becomes NULL.
    """
    res = seconds(res)
    out = df.select(*KEYS, "ts", "value")
    for start, end, steps in ranges:
        inside = lambda ts: all_of(
            ([] if start is None else [ts >= instant(start)])
            + ([] if end is None else [ts <= instant(end if len(end) > 10 else f"{end} 23:59:59.999999")])
        )
        source = shift("ts", -steps * res)
        moved = F.lag("value", steps) if steps > 0 else F.lead("value", -steps)
        w = halo_window()
        d = with_halo(out, res, max(steps, 0), max(-steps, 0)).withColumn("_moved", moved.over(w)).filter("home")
        new = F.when(inside(source), F.col("_moved"))
        out = d.select(*KEYS, "ts", F.when(inside(F.col("ts")), new).otherwise(F.col("value")).alias("value"))
    return out


def fill_covariates(df: DataFrame, res: int | str = "1h") -> DataFrame:
    """Regular grid, time interpolation, then forward fill."""
    return impute(impute(to_grid(df, res, keep_slice=True), res, "time"), res, "pad")


def broadcast_covariates(covs: DataFrame, series: DataFrame, cells: int | None = None) -> DataFrame:
    """Attach one shared covariate table to every series, with ids ``<field>_<ts_id>``.

    The result by definition holds every covariate row once per series. The covariate rows are dealt to ``cells``
    numbered cells (64, or one for every 100,000 rows) and the list of series is sent to each of them, which makes it
    an equi-join that spreads over more tasks as the table grows.
    """
    cells = cells or max(64, -(-covs.count() // 100_000))
    targets = series.select("ts_id").distinct().withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    shared = covs.select(F.col("id").alias("field"), "ts", "value", F.pmod(F.xxhash64("id", "ts"), F.lit(cells)).cast("int").alias("_cell"))
    return shared.join(targets, "_cell").select("ts_id", F.concat_ws("_", "field", "ts_id").alias("id"), "ts", "value")
