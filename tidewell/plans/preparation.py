"""The whole preparation of a series table as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..model import seconds
from ..operators.clean import dedup_first, drop_outliers, filter_years, outlier_report, remove_short_islands, short_island_report, to_grid, to_local
from ..operators.impute import impute, impute_historical, imputed_report, null_ranges
from ..operators.resample import coarser, resample


@dataclass(frozen=True)
class Preparation:
    """What to do with a series table. None or -1 switches a step off."""

    res: int | str
    to: int | str | None = None
    method: str = "averaging"
    years: tuple[int, int] | None = None
    country: str | None = None
    std_dev: float | None = 4.5
    imputation: str = "linear"
    max_thr: int = -1
    min_island: int = -1
    cut: str | None = None
    a: float = 0.3
    wncutoff: float = 0.000694
    ycutoff: int = 3
    ydcutoff: int = 30


def prepare(df: DataFrame, p: Preparation, tz_map: DataFrame | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """Local time, years, first of duplicate timestamps, outliers, grid, gaps, short islands, resampling.

    The grid always comes before the gap filling. Filters reach the scan; the grid leaves its rows clustered by
    (component, slice), which the linear fill reuses without another shuffle.
    """
    return _prepared(df, p, tz_map, holidays, False)[0]


def prepare_reported(
    df: DataFrame, p: Preparation, tz_map: DataFrame | None = None, holidays: DataFrame | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The prepared series and what each step did: ``outliers``, ``imputed`` and ``short_islands`` (values) and
    ``residual_ranges`` (runs of values that are still missing).

    Reports are lazy and taken from the frame that the step itself worked on, before the next one changes it.
    """
    return _prepared(df, p, tz_map, holidays, True)


def _prepared(df: DataFrame, p: Preparation, tz_map: DataFrame | None, holidays: DataFrame | None, report: bool) -> tuple[DataFrame, dict[str, DataFrame]]:
    if "row_id" not in df.columns:
        raise ValueError("the column row_id is needed to tell which of several values at one time is the first")
    if p.to is not None:
        coarser(p.res, p.to)
    order, reports = ["row_id"], {}
    if tz_map is not None:
        df, order = to_local(df, tz_map, p.country), ["utc_ts", "row_id"]
    if p.years is not None:
        df = filter_years(df, *p.years)
    d = dedup_first(df, *order)
    if p.std_dev is not None:
        reports["outliers"] = outlier_report(d, p.std_dev)
        d = drop_outliers(d, p.std_dev)
    if p.imputation == "historical":
        d = impute_historical(to_grid(d, p.res), p.res, holidays, p.a, p.wncutoff, p.ycutoff, p.ydcutoff, p.cut, p.max_thr, flag=report)
    else:
        d = impute(to_grid(d, p.res, keep_slice=True), p.res, p.imputation, p.max_thr, flag=report)
    if report:
        reports["imputed"] = imputed_report(d)
    if p.min_island != -1 and p.imputation != "none":
        reports["short_islands"] = short_island_report(d, p.res, p.min_island)
        d = remove_short_islands(d, p.res, p.min_island)
    if p.to is not None and seconds(p.to) != seconds(p.res):
        d = resample(d, p.to, p.method, p.res)
    d = d.select("ts_id", "id", "ts", "value")
    if report:
        reports["residual_ranges"] = null_ranges(d, p.to or p.res)
    return d, reports
