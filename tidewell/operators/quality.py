"""Data-quality rules. Every rule returns its violations as rows ``(rule, ts_id, id, row_id, detail)``.

``raw`` tables hold the text of a file (see ``sources.readers``); ``series`` tables are canonical with ``row_id``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, col, instant
from ..slices import neighbours
from ..sources.layouts import ROWS_PER_SLICE, TIME_NAME, parse_ts
from .profile import infer_resolution


class ValidationError(ValueError):
    """Raised by :func:`assert_valid`; carries the first violation."""


def _report(df: DataFrame, rule: str, detail: Column, ts_id="ts_id", id="id", row_id="row_id") -> DataFrame:
    part = lambda c, t: (F.lit(None) if c is None else col(c)).cast(t)
    return df.select(
        F.lit(rule).alias("rule"),
        part(ts_id, "string").alias("ts_id"),
        part(id, "string").alias("id"),
        part(row_id, "bigint").alias("row_id"),
        detail.cast("string").alias("detail"),
    )


def _text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def v_empty(df: DataFrame, least: int = 1) -> DataFrame:
    """The table has at least ``least`` rows (2 for a single series)."""
    n = df.agg(F.count("*").alias("n")).filter(F.col("n") < least)
    return _report(n, "V-01", F.col("n"), None, None, None)


def v_columns(names: list[str], layout: str) -> list[str]:
    """Problems with the column names of a file without its index column; an empty list when they are right."""
    if layout == "single":
        return [] if names == ["Datetime", "Value"] else [f"expected Datetime, Value; got {names}"]
    if layout == "covariate":  # a single covariate names its value column freely
        return [] if len(names) == 2 and names[0] == "Datetime" else [f"expected Datetime and one value; got {names}"]
    have = set(names) | ({"Timeseries ID"} if "ID" in names else set())
    if layout == "long":
        need = {"Datetime", "ID", "Timeseries ID", "Value"}
        return [] if have == need else [f"expected {sorted(need)}; got {names}"]
    rest = have - {"Date", "ID", "Timeseries ID"}
    wrong = sorted(c for c in rest if not re.match(TIME_NAME, c))
    missing = sorted({"Date", "ID", "Timeseries ID"} - have)
    return [f"missing {m}" for m in missing] + [f"not a time of day: {w}" for w in wrong]


def v_date_format(raw: DataFrame) -> DataFrame:
    """All dates have the format of the first row, and a supported one."""
    first = raw.agg(F.min_by("raw_ts", F.col("row_id").try_cast("bigint")))
    with_time = F.length(first.scalar()) > 10
    ok = parse_ts("raw_ts").isNotNull() & ((F.length("raw_ts") > 10) == with_time)
    bad = raw.filter(~F.coalesce(ok, F.lit(False)))
    return _report(bad, "V-03", F.col("raw_ts"), row_id=F.col("row_id").try_cast("bigint"))


def v_value_type(raw: DataFrame) -> DataFrame:
    bad = raw.filter(F.col("raw_value").isNotNull() & F.col("raw_value").try_cast("double").isNull())
    return _report(bad, "V-04", F.col("raw_value"), row_id=F.col("row_id").try_cast("bigint"))


def v_id_not_float(raw: DataFrame) -> DataFrame:
    """Identifiers are text or integers. Only the offending rows are listed."""
    bad = raw.filter(F.col("ts_id").rlike(r"^\d+\.\d+$") | F.col("id").rlike(r"^\d+\.\d+$"))
    return _report(bad, "V-05", F.concat_ws(" ", "ts_id", "id"), row_id=F.col("row_id").try_cast("bigint"))


def v_duplicates(series: DataFrame) -> DataFrame:
    """Rows whose timestamp already occurred in the component (the first one in file order is allowed).

    Two aggregations and a join instead of a window, so that heavily repeated timestamps stay cheap.
    """
    repeated = (
        series.groupBy(*KEYS, "ts")
        .agg(F.count("*").alias("_n"), F.min("row_id").alias("_first"))
        .filter("_n > 1")
        .select(*KEYS, "ts", "_first")
    )
    bad = series.join(repeated, [*KEYS, "ts"]).filter("row_id > _first")
    return _report(bad, "V-07", _text("ts"))


def v_order(series: DataFrame) -> DataFrame:
    """Rows that are earlier than the row before them in the file; all are listed."""
    seen = neighbours(
        series.select(*KEYS, "ts", "row_id"), 1, ["ts"], ROWS_PER_SLICE, order="row_id", position=F.col("row_id")
    )
    return _report(seen.filter(F.col("ts") < F.col("p1.ts")), "V-08", _text("ts"))


def v_index(raw: DataFrame) -> DataFrame:
    """The row index is an integer and complete from 0; reports the start of every missing range."""
    index = F.col("row_id").try_cast("bigint")
    text = _report(raw.filter(index.isNull()), "V-09", F.col("row_id"), row_id=None)
    have = raw.select(index.alias("i")).filter("i is not null").distinct()
    n = raw.agg(F.count("*")).scalar()
    wanted = have.select((F.col("i") + 1).alias("i")).union(raw.sparkSession.range(1).select(F.col("id").alias("i")))
    gaps = wanted.filter((F.col("i") >= 0) & (F.col("i") < n)).join(have, "i", "left_anti")
    return text.union(_report(gaps, "V-09", F.lit("missing"), None, None, "i"))


def v_components(series: DataFrame) -> DataFrame:
    """All series have the same number of components; lists every series when they differ."""
    per = series.groupBy("ts_id").agg(F.count_distinct("id").alias("_n"))
    span = per.agg(F.max("_n") - F.min("_n"))
    return _report(per.filter(span.scalar() > 0), "V-10", F.col("_n"), id=None, row_id=None)


def v_too_short(series: DataFrame) -> DataFrame:
    """A component has at least two known values."""
    per = series.groupBy(*KEYS).agg(F.count("value").alias("_n")).filter("_n < 2")
    return _report(per, "V-11", F.col("_n"), row_id=None)


def v_resolution(series: DataFrame, span: int = 86400) -> DataFrame:
    """All components have one resolution; lists every component when they differ."""
    per = infer_resolution(series.filter("value is not null"), span)
    spread = per.agg(F.max("seconds") - F.min("seconds"))
    return _report(per.filter(spread.scalar() > 0), "V-12", F.col("resolution"), row_id=None)


def v_ends_before_val(series: DataFrame, cut: str) -> DataFrame:
    """A component reaches the first validation date."""
    per = series.groupBy(*KEYS).agg(F.max("ts").alias("_hi")).filter(F.col("_hi") < instant(cut))
    return _report(per, "V-13", _text("_hi"), row_id=None)


def v_nulls_after_val(series: DataFrame, cut: str) -> DataFrame:
    """No missing value at or after the first validation date; reports the first one of each component."""
    bad = series.filter((F.col("ts") >= instant(cut)) & F.col("value").isNull())
    return _report(bad.groupBy(*KEYS).agg(F.min("ts").alias("_ts")), "V-14", _text("_ts"), row_id=None)


def v_nan_in_set(split: DataFrame) -> DataFrame:
    """No missing value in the validation and test sets."""
    bad = split.filter(F.col("split").isin("val", "test") & F.col("value").isNull())
    return _report(bad, "V-15", F.concat_ws(" ", "split", _text("ts")), row_id=None)


def v_series_exists(series: DataFrame, wanted: list[str]) -> DataFrame:
    """Requested series that the table does not hold."""
    ask = series.sparkSession.createDataFrame([(w,) for w in wanted], "ts_id string")
    have = series.filter(F.col("ts_id").isin(wanted)).select("ts_id").distinct()
    return _report(ask.join(have, "ts_id", "left_anti"), "V-18", F.lit("unknown series"), id=None, row_id=None)


def drop_empty(series: DataFrame, allow: bool = True) -> DataFrame:
    """Drop series without any known value; with ``allow=False`` raise when there is one."""
    per = series.groupBy("ts_id").agg(F.count("value").alias("_n"))
    if not allow:
        empty = per.filter("_n = 0").limit(1).collect()
        if empty:
            raise ValidationError(f"V-19 empty series {empty[0]['ts_id']}")
        return series
    return series.join(per.filter("_n > 0"), "ts_id", "left_semi")


def check(raw: DataFrame, series: DataFrame, layout: str) -> DataFrame:
    """All value rules of a file as one table; ``order`` is the order in which the rules are to be reported."""
    single = layout == "single"
    rules = [v_empty(raw, 2 if single else 1)]
    if not single:
        rules.append(v_index(raw if layout == "long" else raw.select("row_id", *RAW_REST).dropDuplicates(["row_id"])))
    rules += [v_date_format(raw), v_value_type(raw)]
    if not single:
        rules.append(v_id_not_float(raw))
    dated = series.filter("ts is not null")
    rules += [v_duplicates(dated), v_order(dated)]
    if not single:
        rules += [v_components(dated), v_too_short(dated), v_resolution(dated)]
    out = None
    for i, r in enumerate(rules):
        r = r.withColumn("order", F.lit(i))
        out = r if out is None else out.unionByName(r)
    return out


RAW_REST = ["ts_id", "id", "raw_ts", "raw_value"]


def assert_valid(violations: DataFrame) -> None:
    """Raise with the first violation: first rule, then first row."""
    first = violations.orderBy("order", F.col("row_id").asc_nulls_last(), "ts_id", "id").limit(1).collect()
    if first:
        v = first[0]
        raise ValidationError(f"{v['rule']} series={v['ts_id']} component={v['id']} row={v['row_id']}: {v['detail']}")

