"""Conversions between the long, the wide ("short") and the document layouts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, col, listed
from ..slices import neighbours

TIME_NAME = r"^\d{2}:\d{2}:\d{2}$"
ROWS_PER_SLICE = 65536


def parse_ts(raw: Column | str) -> Column:
    """Timestamp of ``YYYY-MM-DD`` or ``YYYY-MM-DD HH:MM:SS`` text, NULL for anything else."""
    raw = col(raw)
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$"), raw.try_cast("timestamp_ntz"))


def parse_value(raw: Column | str) -> Column:
    v = col(raw).try_cast("double")
    return F.when(~F.isnan(v), v)


def time_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.match(TIME_NAME, c)]


def clean_ids(df: DataFrame) -> DataFrame:
    """Replace ``/`` in both identifiers by ``_``."""
    return df.withColumns({k: F.translate(k, "/", "_") for k in KEYS})


def default_ts_id(df: DataFrame) -> DataFrame:
    """A missing series id defaults to the component id."""
    if "Timeseries ID" not in df.columns:
        return df.withColumn("Timeseries ID", F.col("ID"))
    return df.withColumn("Timeseries ID", F.coalesce("Timeseries ID", "ID"))


def short_to_long(df: DataFrame) -> DataFrame:
    """One row per day with a column per time of day -> one row per timestamp.

    ``Date`` may be text or a date; the other columns are ``ID``, optionally ``Timeseries ID`` and ``row_id``.
    """
    ids = [c for c in ("row_id", "Date", "ID", "Timeseries ID") if c in df.columns or c == "Timeseries ID"]
    d = default_ts_id(df)
    times = time_columns(d)
    long = d.unpivot(ids, times, "time", "value")
    keep = ["row_id"] if "row_id" in ids else []
    return long.select(
        F.col("Timeseries ID").cast("string").alias("ts_id"),
        F.col("ID").cast("string").alias("id"),
        F.concat_ws(" ", F.col("Date").cast("date").cast("string"), "time").cast("timestamp_ntz").alias("ts"),
        F.col("value").cast("double").alias("value"),
        *keep,
    )


def long_to_short(df: DataFrame, times: list[str]) -> DataFrame:
    """One row per (day, component) with a column per time of day; several values of one cell are averaged.

    ``times`` lists the ``HH:MM:SS`` columns, so that no extra job is needed to discover them; a value at another time
    of day is an error.
    """
    cells = df.select(
        F.to_date("ts").alias("Date"),
        F.col("ts_id").alias("Timeseries ID"),
        F.col("id").alias("ID"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        "value",
    )
    return cells.withColumn("time", listed("time", times)).groupBy("Date", "ID", "Timeseries ID").pivot("time", times).agg(F.avg("value"))


def times_of_day(res: int) -> list[str]:
    """All ``HH:MM:SS`` labels of a resolution in seconds."""
    return [f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}" for s in range(0, 86400, res)]


def unfold_daily(df: DataFrame, source: str, order: str, date: str = "date", doc: str = "doc") -> DataFrame:
    """Unfold documents holding one day each (a map from time of day to value) into rows.

    Of consecutive documents of a source with the same date, in ``order`` (an integer, unique per source), only
    the first counts.
    """
    seen = neighbours(
        df, 1, [date], ROWS_PER_SLICE, keys=[source], order=order, position=F.col(order)
    )
    kept = seen.filter(~F.col("p1")[date].eqNullSafe(F.col(date)))
    return kept.select(source, date, F.explode(doc).alias("time", "value")).select(
        F.col(source).cast("string").alias("ts_id"),
        F.col(source).cast("string").alias("id"),
        F.concat_ws(" ", F.col(date).cast("string"), "time").cast("timestamp_ntz").alias("ts"),
        F.col("value").cast("double").alias("value"),
    )


def normalise_meter(df: DataFrame, order: str) -> DataFrame:
    """Name meter documents ``id power_type`` and keep one document per day and name (the first in ``order``)."""
    rest = [c for c in df.columns if c not in ("date", "id", "power_type", order)]
    named = df.select("date", F.concat_ws(" ", "id", "power_type").alias("name"), order, *rest)
    return (
        named.groupBy("date", "name")
        .agg(F.min_by(F.struct(*rest), order).alias("_d"))
        .select(F.col("date").alias("Date"), F.col("name").alias("ID"), F.col("name").alias("Timeseries ID"), "_d.*")
    )
