"""Queries for calendar features, covariates and the preparation of model input."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewell.functions import calendar
from tidewell.operators import covariates, prep

from .base import (
    LINE,
    ev_fill,
    ev_grid,
    ev_hour,
    ev_multi,
    mean_rounded,
    mean_sql,
    multi_grid,
    od_day,
    part,
    r,
    register,
    rounded,
)
from .cleaning import days_off

HOLIDAY = "CASE WHEN ts::DATE IN (SELECT date FROM days_off) THEN 1 ELSE 0 END"
FIELDS = f"""year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, (week(ts) - 1)::INTEGER AS yearweek, day(ts)::INTEGER AS day,
    hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute, second(ts)::INTEGER AS second, (isodow(ts) - 1)::INTEGER AS weekday,
    (day(ts) - 1)::INTEGER AS monthday, (dayofyear(ts) - 1)::INTEGER AS yearday, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    epoch(ts)::BIGINT AS epoch, {HOLIDAY} AS holiday"""
WN = f"""CASE WHEN {HOLIDAY} = 1 THEN CASE WHEN isodow(ts) = 5 THEN 5 ELSE 6 END ELSE isodow(ts) - 1 END
    + hour(ts) / 24.0::DOUBLE + minute(ts) / 1440.0::DOUBLE"""
DN = "hour(ts) + minute(ts) / 60.0::DOUBLE"
part("od_ev", "SELECT * FROM od_day UNION ALL SELECT * FROM ev_hour", "od_day", "ev_hour")


def both(spark, sf):
    return od_day(spark, sf).unionByName(ev_hour(spark, sf))


@register("f_01_calendar", "od_ev", "days_off", sql=f"SELECT ts_id, id, ts, round(value, 4) AS value, {FIELDS}, round({WN}, 6) AS wn, round({DN}, 6) AS dn FROM od_ev")
def f_01(spark, sf):
    d = calendar.calendar(both(spark, sf), days_off(spark, sf))
    return d.withColumns({"value": r("value"), "wn": r("wn", 6), "dn": r("dn", 6)})


@register("f_02_holidays", "od_day", "days_off", sql=f"SELECT ts_id, id, year(ts)::INTEGER AS year, sum({HOLIDAY})::BIGINT AS days FROM od_day GROUP BY 1, 2, 3")
def f_02(spark, sf):
    d = calendar.with_holidays(od_day(spark, sf), days_off(spark, sf))
    return d.groupBy("ts_id", "id", F.year("ts").alias("year")).agg(F.sum("holiday").alias("days"))


@register("f_03_week_position", "od_ev", "days_off", sql=f"SELECT ts_id, round({WN}, 6) AS wn, count(*) AS n, round(sum(value), 4) AS value FROM od_ev GROUP BY 1, 2")
def f_03(spark, sf):
    d = calendar.week_position(calendar.with_holidays(both(spark, sf), days_off(spark, sf)))
    return d.groupBy("ts_id", r("wn", 6).alias("wn")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("value"))


@register("f_04_day_position", "ev_hour", sql=f"SELECT ts_id, round({DN}, 6) AS dn, count(*) AS n, round(sum(value), 4) AS value FROM ev_hour GROUP BY 1, 2")
def f_04(spark, sf):
    d = calendar.day_position(ev_hour(spark, sf))
    return d.groupBy("ts_id", r("dn", 6).alias("dn")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("value"))


CYCLES = {
    "month": "month(ts)",
    "weekday": "isodow(ts) - 1",
    "monthday": "day(ts) - 1",
    "yearday": "dayofyear(ts) - 1",
    "hour": "hour(ts)",
    "yearweek": "dayofyear(ts) - 1",
}


def _pair(name: str, x: str, period: float) -> str:
    a = f"({2 * math.pi / period!r}::DOUBLE * ({x}))"
    return f"round(sin({a}) + 3.1e-8::DOUBLE, 6) AS {name}_sin, round(cos({a}) + 3.1e-8::DOUBLE, 6) AS {name}_cos"


@register(
    "f_05_cyclical",
    "od_ev",
    sql="SELECT ts_id, id, ts, round(value, 4) AS value, " + ", ".join(_pair(n, x, calendar.PERIODS[n]) for n, x in CYCLES.items()) + " FROM od_ev",
)
def f_05(spark, sf):
    d = calendar.cyclical(both(spark, sf))
    pairs = {f"{n}_{k}": r(F.col(f"{n}_{k}") + 3.1e-8, 6) for n in calendar.PERIODS for k in ("sin", "cos")}
    return d.withColumns({"value": r("value"), **pairs})


COV_FIELDS = {
    "month": "month(ts) - 1",
    "day_of_year": "dayofyear(ts) - 1",
    "hour": "hour(ts)",
    "day_of_week": "isodow(ts) - 1",
    "week_of_year": "week(ts) - 1",
}


def _cov_sql() -> str:
    one = lambda name, x: f"SELECT ts_id, '{name}_' || ts_id AS id, ts, ({x})::DOUBLE AS value FROM stamps"
    out = [one("year", "year(ts)"), one("holiday", HOLIDAY)]
    for n, x in COV_FIELDS.items():
        for f in ("sin", "cos"):
            out.append(one(f"{n}_{f}", f"{f}({2 * math.pi / calendar.COVARIATE_PERIODS[n]!r}::DOUBLE * ({x}))"))
    return " UNION ALL ".join(out)


part("stamps", "SELECT DISTINCT ts_id, ts FROM ev_multi", "ev_multi")
part("time_covs", _cov_sql(), "stamps", "days_off")


@register("f_06_time_covariates", "time_covs", sql="SELECT ts_id, id, ts, round(value + 3.1e-8::DOUBLE, 6) AS value FROM time_covs")
def f_06(spark, sf):
    d = calendar.time_covariates(ev_multi(spark, sf), days_off(spark, sf))
    return d.withColumn("value", r(F.col("value") + 3.1e-8, 6))


@register(
    "f_07_add_future_covariates",
    "time_covs",
    sql="""SELECT ts_id, id, count(*) AS n, round(sum(value), 4) AS total FROM (
        SELECT * FROM time_covs UNION ALL SELECT ts_id, 'load_' || id, ts, value FROM ev_multi) GROUP BY 1, 2""",
)
def f_07(spark, sf):
    d = ev_multi(spark, sf)
    given = d.withColumn("id", F.concat(F.lit("load_"), "id"))
    out = calendar.add_future_covariates(given, d, days_off(spark, sf))
    return out.groupBy("ts_id", "id").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@register(
    "j_01_attach_covariates",
    "ev_hour",
    "ev_multi",
    sql="""SELECT e.ts_id, e.id, e.ts, round(e.value, 4) AS value, round(a.value, 4) AS "0", round(b.value, 4) AS "1", round(c.value, 4) AS "2" FROM ev_hour e
        LEFT JOIN (SELECT * FROM ev_multi WHERE id = '2') c ON c.ts_id = e.ts_id AND c.ts = e.ts
        LEFT JOIN (SELECT * FROM ev_multi WHERE id = '0') a ON a.ts_id = e.ts_id AND a.ts = e.ts
        LEFT JOIN (SELECT * FROM ev_multi WHERE id = '1') b ON b.ts_id = e.ts_id AND b.ts = e.ts""",
)
def j_01(spark, sf):
    d = covariates.attach_covariates(ev_hour(spark, sf), ev_multi(spark, sf), ["0", "1", "2"])
    return rounded(d, "value", "0", "1", "2")


@register(
    "j_03_combine_components",
    "ev_multi",
    sql="SELECT ts_id, id, ts, round(value + value, 4) AS value FROM ev_multi",
)
def j_03c(spark, sf):
    d = ev_multi(spark, sf)
    return rounded(covariates.combine(d, d, "+"))


@register(
    "p_06_scale_untrained",
    "ev_multi",
    sql="""SELECT e.ts_id, e.id, e.ts, round((e.value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4) AS value FROM ev_multi e
        LEFT JOIN (SELECT ts_id, id, min(value) AS lo, max(value) AS hi FROM ev_multi WHERE id <> '0' GROUP BY 1, 2) s
            ON s.ts_id = e.ts_id AND s.id = e.id""",
)
def p_06u(spark, sf):
    d = ev_multi(spark, sf)
    return rounded(prep.scale(d, prep.fit_minmax(d.filter("id <> '0'"))))


@register(
    "j_02_prepare_covariates",
    "multi_fill",
    sql=f"""SELECT ts_id, id, date_trunc('day', ts) + to_hours((hour(ts) // 6 * 6)::INTEGER) AS ts, {mean_sql('avg(value)')} AS value
        FROM multi_fill WHERE year(ts) = 2024 GROUP BY 1, 2, 3""",
)
def j_02(spark, sf):
    return mean_rounded(covariates.prepare_covariates(ev_multi(spark, sf), "1h", 2024, 2024, "6h", "averaging"))


def _combine(sign: str):
    def query(spark, sf):
        side = ev_multi(spark, sf).filter("id = '0'")
        return rounded(covariates.combine(ev_hour(spark, sf), side, sign))

    return query


for _sign, _name in (("+", "add"), ("-", "subtract")):
    register(
        f"j_03_combine_{_name}",
        "ev_hour",
        "ev_multi",
        sql=f"""SELECT e.ts_id, e.id, e.ts, round(e.value {_sign} a.value, 4) AS value FROM ev_hour e
            JOIN ev_multi a ON a.ts_id = e.ts_id AND a.ts = e.ts AND a.id = '0'""",
    )(_combine(_sign))


@register(
    "j_07_stitch",
    "ev_multi",
    sql="""WITH base AS (SELECT * FROM ev_multi WHERE ts < TIMESTAMP '2024-01-10 00:00:00' AND id <> '2'),
        newer AS (SELECT ts_id, id, ts, value * 2 AS value FROM ev_multi)
        SELECT ts_id, id, ts, round(value, 4) AS value FROM base
        UNION ALL SELECT n.ts_id, n.id, n.ts, round(n.value, 4) FROM newer n
            LEFT JOIN (SELECT ts_id, id, max(ts) AS last FROM base GROUP BY 1, 2) b ON b.ts_id = n.ts_id AND b.id = n.id
            WHERE b.last IS NULL OR n.ts > b.last""",
)
def j_07(spark, sf):
    d = ev_multi(spark, sf)
    base = d.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).filter("id <> '2'")
    return rounded(covariates.stitch(base, d.withColumn("value", F.col("value") * 2)))


SHIFTS = [("2024-01-06", "2024-01-13", 3), (None, "2024-01-09", -2), ("2024-01-20", None, -1)]


def _shift_sql() -> str:
    parts, src = [], "ev_grid"
    for i, (a, z, n) in enumerate(SHIFTS):
        inside = [f"ts >= TIMESTAMP '{a} 00:00:00'"] * (a is not None) + [f"ts <= TIMESTAMP '{z} 23:59:59'"] * (z is not None)
        inside = " AND ".join(inside)
        fn = f"lag(value, {n})" if n > 0 else f"lead(value, {-n})"
        parts.append(
            f"""s{i} AS (SELECT ts_id, id, ts, CASE WHEN {inside} THEN {fn} OVER (PARTITION BY ts_id, id, ({inside}) ORDER BY ts)
            ELSE value END AS value FROM {src})"""
        )
        src = f"s{i}"
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT ts_id, id, ts, round(value, 4) AS value FROM {src})"


@register("j_08_shift_ranges", "ev_grid", sql=_shift_sql())
def j_08(spark, sf):
    return rounded(covariates.shift_ranges(ev_grid(spark, sf), "1h", SHIFTS))


@register(
    "j_09_fill_covariates",
    "multi_known",
    sql=f"""SELECT ts_id, id, ts, {mean_sql('last_value(x IGNORE NULLS) OVER (PARTITION BY ts_id, id ORDER BY ts)')} AS value
        FROM (SELECT *, {LINE} AS x FROM multi_known)""",
)
def j_09(spark, sf):
    return mean_rounded(covariates.fill_covariates(ev_multi(spark, sf), "1h"))


@register(
    "j_10_broadcast_covariates",
    "ev_hour",
    "ev_multi",
    sql="""SELECT s.ts_id, c.id || '_' || s.ts_id AS id, c.ts, round(c.value, 4) AS value
        FROM (SELECT DISTINCT ts_id FROM ev_hour) s, (SELECT * FROM ev_multi WHERE ts_id = 'click') c""",
)
def j_10(spark, sf):
    shared = ev_multi(spark, sf).filter("ts_id = 'click'")
    return rounded(covariates.broadcast_covariates(shared, ev_hour(spark, sf)))


# Weights of seven values for the quadratic through them, read off at each of the seven, times 42.
QUADRATIC_7 = [
    [x / 42 for x in row]
    for row in (
        (32, 15, 3, -4, -6, -3, 5),
        (15, 12, 9, 6, 3, 0, -3),
        (3, 9, 12, 12, 9, 3, -6),
        (-4, 6, 12, 14, 12, 6, -4),
        (-6, 3, 9, 12, 12, 9, 3),
        (-3, 0, 3, 6, 9, 12, 15),
        (5, -3, -6, -4, 3, 15, 32),
    )
]


def _savgol_sql(window: int, order: int) -> str:
    half, w = window // 2, QUADRATIC_7

    def at(p: int) -> str:
        terms = []
        for j in range(window):
            k = j - p
            v = "value" if k == 0 else f"{'lead' if k > 0 else 'lag'}(value, {abs(k)}) OVER w"
            terms.append(f"{float(w[p][j])!r}::DOUBLE * {v}")
        return " + ".join(terms)

    cases = " ".join(f"WHEN i = {p + 1} THEN {at(p)} WHEN i = n - {p} THEN {at(window - 1 - p)}" for p in range(half))
    return f"""SELECT ts_id, id, ts, round(CASE {cases} ELSE {at(half)} END, 3) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY ts_id, id ORDER BY ts) AS i, count(*) OVER (PARTITION BY ts_id, id) AS n FROM ev_fill)
        WINDOW w AS (PARTITION BY ts_id, id ORDER BY ts)"""


@register("p_01_savgol", "ev_fill", sql=_savgol_sql(7, 2))
def p_01(spark, sf):
    return rounded(prep.savgol(ev_fill(spark, sf), "1h", 7, 2), digits=3)


@register(
    "p_02_split_fragments",
    "multi_grid",
    sql="""WITH t AS (SELECT ts_id, ts, bool_or(value IS NULL) AS gap FROM multi_grid GROUP BY 1, 2),
        f AS (SELECT ts_id, ts, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY ts_id ORDER BY ts) - 1 AS fragment_id FROM (
            SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY ts_id ORDER BY ts) <> INTERVAL 1 HOUR, true) AS b FROM t WHERE NOT gap))
        SELECT ts_id, id, ts, round(value, 4) AS value, fragment_id::BIGINT AS fragment_id FROM multi_grid JOIN f USING (ts_id, ts)""",
)
def p_02(spark, sf):
    return rounded(prep.split_fragments(multi_grid(spark, sf), "1h"))


@register(
    "p_03_split",
    "ev_hour",
    sql="""SELECT split, ts_id, id, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS lo, max(ts) AS hi FROM (
        SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' WHEN ts < TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END AS split
        FROM ev_hour WHERE ts < TIMESTAMP '2024-01-29'
        UNION ALL SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'val' END FROM ev_hour
        UNION ALL SELECT *, 'test' FROM ev_hour WHERE ts >= TIMESTAMP '2024-01-20') GROUP BY 1, 2, 3""",
)
def p_03(spark, sf):
    d = ev_hour(spark, sf)
    out = prep.split(d, "20240115", "20240122", "20240128").unionByName(prep.split(d, "20240120", "20240120"))
    return out.groupBy("split", "ts_id", "id").agg(
        F.count("*").alias("n"), r(F.sum("value")).alias("total"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )


@register(
    "p_04_split_info",
    "ev_multi",
    sql="""SELECT ts_id, min(ts::DATE) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22') AS val_start,
        min(ts::DATE) FILTER (ts >= TIMESTAMP '2024-01-22') AS test_start, max(ts::DATE) AS test_end FROM ev_multi GROUP BY 1""",
)
def p_04(spark, sf):
    return prep.split_info(ev_multi(spark, sf), "20240115", "20240122")


part("ev_scaler", "SELECT ts_id, id, min(value) AS lo, max(value) AS hi FROM ev_multi WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2", "ev_multi")


def _scaler(spark, sf):
    return prep.fit_minmax(prep.split(ev_multi(spark, sf), "20240115", "20240122"))


@register("p_05_fit_minmax", "ev_scaler", sql="SELECT ts_id, id, round(lo, 4) AS lo, round(hi, 4) AS hi FROM ev_scaler")
def p_05(spark, sf):
    return rounded(_scaler(spark, sf), "lo", "hi")


@register(
    "p_06_scale",
    "ev_scaler",
    sql="""SELECT ts_id, id, ts, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS value
        FROM ev_multi JOIN ev_scaler USING (ts_id, id)""",
)
def p_06(spark, sf):
    return rounded(prep.scale(ev_multi(spark, sf), _scaler(spark, sf)), digits=6)


@register("p_07_unscale", "ev_multi", sql="SELECT ts_id, id, ts, round(value, 4) AS value FROM ev_multi")
def p_07(spark, sf):
    s = _scaler(spark, sf)
    return rounded(prep.unscale(prep.scale(ev_multi(spark, sf), s), s))


@register(
    "p_08_stack",
    "ev_multi",
    sql="""SELECT ts_id, ts, round(max(value) FILTER (id = '0'), 4) AS "0", round(max(value) FILTER (id = '1'), 4) AS "1",
        round(max(value) FILTER (id = '2'), 4) AS "2" FROM ev_multi GROUP BY 1, 2""",
)
def p_08(spark, sf):
    return rounded(prep.stack(ev_multi(spark, sf), ["0", "1", "2"]), "0", "1", "2")


@register(
    "p_09_fragment_covariates",
    "ev_grid",
    "ev_multi",
    sql="""WITH f AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY ts_id ORDER BY ts) - 1 AS fragment_id FROM (
            SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY ts_id ORDER BY ts) <> INTERVAL 1 HOUR, true) AS b
            FROM ev_grid WHERE value IS NOT NULL))
        SELECT f.ts_id, fragment_id::BIGINT AS fragment_id, count(*) AS steps, round(sum(c.value), 4) AS covariate FROM f
        LEFT JOIN (SELECT * FROM ev_multi WHERE id = '0') c ON c.ts_id = f.ts_id AND c.ts = f.ts GROUP BY 1, 2""",
)
def p_09(spark, sf):
    frags = prep.split_fragments(ev_grid(spark, sf), "1h")
    d = covariates.attach_covariates(frags, ev_multi(spark, sf), ["0", "1", "2"])
    return d.groupBy("ts_id", "fragment_id").agg(F.count("*").alias("steps"), r(F.sum("0")).alias("covariate"))


