"""The canonical series table and small column helpers shared by all operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["ts_id", "id"]
DAY = 86400
FIRST_YEAR = 62135596800  # seconds from the year 1 to 1970

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("ts_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Seconds per unit letter of a resolution such as 15min or 1h.
UNIT_SECONDS = {"s": 1, "min": 60, "h": 3600, "d": 86400}


def seconds(resolution: int | str) -> int:
    """Turn ``'15min'``, ``'1h'``, ``'d'`` or a number of seconds into seconds."""
    if isinstance(resolution, int):
        return resolution
    match = re.fullmatch(r"(\d*)\s*(s|min|h|d)", resolution.strip().lower())
    if not match:
        raise ValueError(f"not a resolution: {resolution!r}")
    return int(match.group(1) or 1) * UNIT_SECONDS[match.group(2)]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, rounded down, whatever the session time zone is.

    Counted from the first supported year, so that cutting the fraction always rounds down.
    """
    if isinstance(ts, str):
        return F.expr(f"cast(cast({ts} - timestamp_ntz'0001-01-01 00:00:00' as interval second) as bigint) - {FIRST_YEAR}")
    since = (ts - F.expr("timestamp_ntz'0001-01-01 00:00:00'")).cast("interval second").cast("bigint")
    return since - FIRST_YEAR


def from_epoch(secs: Column | str) -> Column:
    return shift(F.expr("timestamp_ntz'1970-01-01 00:00:00'"), secs)


def shift(ts: Column | str, secs: Column | str | int) -> Column:
    """``ts`` moved by a number of seconds."""
    secs = F.lit(secs) if isinstance(secs, int) else col(secs)
    return col(ts) + F.expr("interval '1' second") * secs.cast("bigint")


def instant(text: str) -> Column:
    """A zone-less timestamp literal; accepts ``YYYYMMDD`` and ISO text."""
    text = text.strip()
    if re.fullmatch(r"\d{8}", text):
        text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
    return F.lit(text).cast("timestamp_ntz")


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer division rounding down, exact on BIGINT."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    a = a.cast("bigint")
    return F.call_function("div", a - F.pmod(a, b), b)


def null_if_nan(c: Column | str) -> Column:
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def canonical(
    df: DataFrame,
    ts_id: Column | str = "ts_id",
    id: Column | str = "id",
    ts: Column | str = "ts",
    value: Column | str = "value",
    row_id: Column | str | None = None,
) -> DataFrame:
    """Project any table to the canonical columns; NaN becomes NULL."""
    cols = [
        col(ts_id).cast("string").alias("ts_id"),
        col(id).cast("string").alias("id"),
        col(ts).cast("timestamp_ntz").alias("ts"),
        null_if_nan(value).alias("value"),
    ]
    if row_id is not None:
        cols.append(col(row_id).cast("bigint").alias("row_id"))
    return df.select(*cols)


def all_of(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def listed(name: str, values: list[str]):
    """The column, or an error where it holds something outside ``values``."""
    c = F.col(name)
    return F.when(c.isin(*values), c).otherwise(F.raise_error(F.concat(F.lit(f"{name} is not listed: "), F.coalesce(c, F.lit("NULL")))))
