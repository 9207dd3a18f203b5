"""Row selection, local time, de-duplication, regular grids and outlier rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantile import exact_quantile
from ..model import KEYS, col, epoch, floor_div, from_epoch, seconds
from ..slices import SLICE, halo_window, nearest, span_of, sure, with_halo


def filter_years(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Keep the years ``lo`` to ``hi``; without years, those that the first component (by name) spans."""
    if lo is not None:
        hi = lo if hi is None else hi
        return df.filter(
            (F.col("ts") >= F.lit(f"{lo:04d}-01-01").cast("timestamp_ntz"))
            & (F.col("ts") < F.lit(f"{hi + 1:04d}-01-01").cast("timestamp_ntz"))
        )
    per = df.groupBy(*KEYS).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    first = per.agg(F.min_by(F.struct("lo", "hi"), F.struct(*KEYS)).alias("s"))
    lo_year = first.select(F.year("s.lo")).scalar()
    hi_year = first.select(F.year("s.hi")).scalar()
    return df.filter(F.year("ts").between(lo_year, hi_year))


def select_series(df: DataFrame, ts_id: str) -> DataFrame:
    return df.filter(F.col("ts_id") == ts_id)


def to_local(df: DataFrame, tz_map: DataFrame, default: str | None = None) -> DataFrame:
    """UTC to local wall time. The component id is tried as a country, then ``default``, else nothing changes.

    ``tz_map(country, tz)`` states one zone per country; two zones are an error. The UTC time is kept as ``utc_ts``: the hour that occurs
    twice in autumn is then de-duplicated by ``dedup_first(df, 'utc_ts')``.
    """
    clash = F.raise_error(F.concat(F.lit("several time zones for "), F.col("country")))
    own = tz_map.groupBy("country").agg(F.min("tz").alias("_a"), F.max("tz").alias("_z"))
    own = own.select(F.col("country").alias("id"), F.when(F.col("_a") == F.col("_z"), F.col("_z")).otherwise(clash).alias("_tz"))
    d = df.join(own, "id", "left").select(*df.columns, "_tz")
    tz = F.col("_tz")
    if default is not None:
        tz = F.coalesce(tz, tz_map.filter(F.col("country") == default).agg(F.max("tz")).scalar())
    local = F.when(tz.isNull(), F.col("ts")).otherwise(F.convert_timezone(F.lit("UTC"), tz, "ts"))
    return d.withColumn("utc_ts", F.col("ts")).withColumn("ts", local).drop("_tz")


def dedup_first(df: DataFrame, *order: str) -> DataFrame:
    """One row per timestamp: the first by the columns ``order`` (``row_id`` if none is named).

    An aggregate, so repeated timestamps shrink before the shuffle.
    """
    return df.groupBy(*KEYS, "ts").agg(F.min_by("value", F.struct(*(order or ("row_id",)))).alias("value"))


def to_grid(df: DataFrame, res: int | str, span: int | None = None, keep_slice: bool = False) -> DataFrame:
    """Regular grid from the first to the last timestamp of every component.

    Missing steps appear with NULL, rows off the grid are dropped. Timestamps must be unique. Every slice is
    completed on its own: the rows of a slice are ordered once, and each row also emits the missing steps up to its
    successor; slices without rows come from a skeleton of one row per slice. One shuffle of the data in total.
    """
    res = seconds(res)
    span = span or span_of(res)
    at = epoch("ts")
    fraction = lambda ts: col(ts) - from_epoch(epoch(ts))  # noqa: E731  below one second, as an interval
    # the same filter in both branches, and columns that cannot be NULL, let them share what comes before
    df = df.filter("ts_id is not null and id is not null and ts is not null")
    bounds = df.groupBy(*KEYS).agg(F.min("ts").alias("_k0"), F.max("ts").alias("_k1"))
    skeleton = bounds.select(
        *KEYS, epoch("_k0").alias("_s0"), epoch("_k1").alias("_s1"), fraction("_k0").alias("_frac0")
    ).withColumn(SLICE, F.explode(F.sequence(floor_div(F.col("_s0"), span), floor_div(F.col("_s1"), span))))
    data = df.select(
        *[F.col(k).alias(f"_{k}") for k in KEYS],
        sure(floor_div(at, span)).alias("_slice"),
        sure(at).alias("_at"),
        F.coalesce(fraction("ts"), F.expr("interval '0 00:00:00' day to second")).alias("_frac"),
        "value",
    )
    # the keys of the join are exactly (component, slice), so that its partitioning serves the window as well; the
    # grid test is a range condition and therefore stays out of the keys
    on = (
        (F.col("ts_id") == F.col("_ts_id"))
        & (F.col("id") == F.col("_id"))
        & (F.col(SLICE) == F.col("_slice"))
        & (F.pmod(F.col("_at") - F.col("_s0"), F.lit(res)) <= 0)
        & (F.col("_frac") <= F.col("_frac0"))
        & (F.col("_frac") >= F.col("_frac0"))
    )
    d = skeleton.join(data, on, "left")
    # first and last grid step inside the slice
    start = F.col("_s0") + floor_div(F.greatest(F.col(SLICE) * span - F.col("_s0"), F.lit(0)) + (res - 1), res) * res
    stop = F.least(F.col("_s1"), (F.col(SLICE) + 1) * span - 1)
    w = Window.partitionBy(*KEYS, SLICE).orderBy("_at")
    lead = F.lead("_at").over(w)
    lag = F.lag("_at").over(w)
    d = (
        d.withColumn("_prev", lag)
        .withColumn("_until", F.coalesce(lead - res, stop))
        .withColumn("_from", F.when(F.col("_prev").isNull(), start).otherwise(F.col("_at")))
        .filter("_from <= _until")
        .withColumn("_s", F.explode(F.sequence("_from", "_until", F.lit(res).cast("bigint"))))
    )
    out = d.select(
        *KEYS,
        SLICE,
        (from_epoch("_s") + F.col("_frac0")).alias("ts"),
        F.when(F.col("_s") == F.col("_at"), F.col("value")).alias("value"),
    )
    return out if keep_slice else out.drop(SLICE)


def cut_common_span(df: DataFrame) -> DataFrame:
    """Within every series cut all components to [latest start, earliest end]."""
    per = df.groupBy(*KEYS).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    common = per.groupBy("ts_id").agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi"))
    return df.join(common, "ts_id").filter(F.col("ts").between(F.col("_lo"), F.col("_hi"))).select(*df.columns)


def _judged(df: DataFrame, std_dev: float) -> DataFrame:
    """Known rows with ``_out``: strictly outside mean +- std_dev * std of the calendar month over all years."""
    known = df.filter("value is not null").withColumn("_month", F.month("ts"))
    stats = known.groupBy(*KEYS, "_month").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"))
    far = F.abs(F.col("value") - F.col("_mean")) > std_dev * F.col("_std")
    return known.join(stats, [*KEYS, "_month"]).withColumn("_out", F.coalesce(far, F.lit(False)))


def drop_outliers(df: DataFrame, std_dev: float = 4.5) -> DataFrame:
    """Known values that pass the monthly rule; missing and removed rows are absent."""
    return _judged(df, std_dev).filter("not _out").select(*KEYS, "ts", "value")


def remove_outliers(df: DataFrame, res: int | str, std_dev: float = 4.5, **grid) -> DataFrame:
    """Monthly z-rule, then the regular grid: inner outliers become NULL, outer ones are trimmed."""
    return to_grid(drop_outliers(df, std_dev), res, **grid)


def outlier_report(df: DataFrame, std_dev: float = 4.5) -> DataFrame:
    """The removed values, one per timestamp."""
    return _judged(df, std_dev).filter("_out").groupBy(*KEYS, "ts").agg(F.min("value").alias("value"))


def remove_post_gap_spikes(df: DataFrame, res: int | str, q: float = 0.99, span: int | None = None) -> DataFrame:
    """On a grid: the first value after a run of missing ones is removed if it is 0 or reaches the ``q`` quantile."""
    res = seconds(res)
    cut = exact_quantile(df, KEYS, "value", q, "_cut")
    w = halo_window()
    seen = (
        with_halo(df.select(*KEYS, "ts", "value"), res, 1, 0, span)
        .withColumn("_gap", F.lag(F.col("value").isNull()).over(w))
        .filter("home")
        .join(cut, KEYS, "left")
    )
    spike = F.col("_gap") & ((F.col("value") >= F.col("_cut")) | (F.col("value") == 0))
    return seen.select(*KEYS, "ts", F.when(~F.coalesce(spike, F.lit(False)), F.col("value")).alias("value"))


def island_length(df: DataFrame, res: int, span: int | None = None) -> DataFrame:
    """On a grid: add ``island``, the number of consecutive known values around every known value."""
    d = nearest(df, F.col("value").isNull(), [], span or span_of(res))
    lo = F.coalesce(epoch("prev.ts") + res, epoch("k_start"))
    hi = F.coalesce(epoch("next.ts") - res, epoch("k_end"))
    return d.withColumn("island", F.when(F.col("value").isNotNull(), floor_div(hi - lo, res) + 1)).drop(
        "prev", "next", "k_start", "k_end"
    )


def remove_short_islands(df: DataFrame, res: int | str, m: int, span: int | None = None) -> DataFrame:
    """On a grid: runs of at most ``m`` known values become NULL."""
    res = seconds(res)
    if m == -1:
        return df
    d = island_length(df.select(*KEYS, "ts", "value"), res, span)
    return d.select(*KEYS, "ts", F.when(F.col("island") > m, F.col("value")).alias("value"))


def short_island_report(df: DataFrame, res: int | str, m: int, span: int | None = None) -> DataFrame:
    """The values that :func:`remove_short_islands` turns into NULL."""
    d = island_length(df.select(*KEYS, "ts", "value"), seconds(res), span)
    return d.filter(F.col("island") <= m).select(*KEYS, "ts", "value")


