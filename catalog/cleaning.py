"""Queries for row selection, grids, outliers, gap filling and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import clean, impute, resample

from .base import (
    LINE,
    OFF_TIE,
    ev_grid,
    ev_hour,
    ev_multi,
    ev_raw,
    known_sql,
    li_day,
    mean_rounded,
    mean_sql,
    multi_grid,
    od_day,
    od_grid,
    od_stored,
    part,
    register,
    rounded,
    table,
)

# one zone per priority, as a user would state it
ZONES = {"1-URGENT": "Europe/Athens", "2-HIGH": "Europe/Lisbon", "3-MEDIUM": "America/New_York"}
DEFAULT_ZONE = "Asia/Tokyo"


@register(
    "e_01_filter_years",
    "od_day",
    sql="""SELECT ts_id, id, ts, round(value, 4) AS value FROM od_day WHERE year(ts) BETWEEN 1996 AND 1997
        UNION ALL SELECT ts_id, id, ts, round(value, 4) FROM od_day WHERE year(ts) BETWEEN
            (SELECT year(min(ts)) FROM od_day WHERE id = (SELECT min(id) FROM od_day)) AND
            (SELECT year(max(ts)) FROM od_day WHERE id = (SELECT min(id) FROM od_day))""",
)
def e_01(spark, sf):
    d = od_day(spark, sf)
    return rounded(clean.filter_years(d, 1996, 1997).unionByName(clean.filter_years(d)))


@register("e_02_select_series", "ev_multi", sql="SELECT ts_id, id, ts, round(value, 4) AS value FROM ev_multi WHERE ts_id = 'click'")
def e_02(spark, sf):
    return rounded(clean.select_series(ev_multi(spark, sf), "click"))


LOCAL = """SELECT ts_id, id, CASE """ + " ".join(
    f"WHEN id = '{k}' THEN ts AT TIME ZONE 'UTC' AT TIME ZONE '{z}'" for k, z in ZONES.items()
) + f""" ELSE ts AT TIME ZONE 'UTC' AT TIME ZONE '{DEFAULT_ZONE}' END AS ts, ts AS utc_ts, value FROM od_hours"""
part(
    "od_hours",
    """SELECT o_orderpriority AS ts_id, o_orderpriority AS id, (o_orderdate + to_hours((o_orderkey % 24)::INTEGER))::TIMESTAMP AS ts,
        sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3""",
)
part("od_local", LOCAL, "od_hours")


def od_local(spark, sf):
    """Orders spread over the hours of their day, in local time."""
    o = table(spark, sf, "orders")
    ts = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval '1' hour") * (F.col("o_orderkey") % 24)
    d = o.groupBy(F.col("o_orderpriority").alias("ts_id"), ts.alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    d = d.select("ts_id", F.col("ts_id").alias("id"), "ts", "value")
    zones = spark.createDataFrame([*ZONES.items(), ("JP", DEFAULT_ZONE)], "country string, tz string")
    return clean.to_local(d, zones, "JP")


@register("e_03_to_local", "od_local", sql="SELECT ts_id, id, ts, utc_ts, round(value, 4) AS value FROM od_local")
def e_03(spark, sf):
    return rounded(od_local(spark, sf))


@register(
    "e_04_dedup_first",
    "od_local",
    sql="SELECT ts_id, id, ts, round(arg_min(value, utc_ts), 4) AS value FROM od_local GROUP BY 1, 2, 3",
)
def e_04(spark, sf):
    return rounded(clean.dedup_first(od_local(spark, sf), "utc_ts"))


@register(
    "e_05_to_grid",
    "ev_grid",
    "od_grid",
    sql="""SELECT ts_id, id, ts, round(value, 4) AS value FROM ev_grid UNION ALL SELECT ts_id, id, ts, round(value, 4) FROM od_grid
        UNION ALL (WITH b AS (SELECT ts_id, id, min(ts) AS lo, max(ts) AS hi FROM ev_hour GROUP BY 1, 2),
            g AS (SELECT ts_id, id, unnest(generate_series(lo, hi, INTERVAL 7 HOUR)) AS ts FROM b)
            SELECT g.ts_id, g.id, g.ts, round(h.value, 4) FROM g LEFT JOIN ev_hour h USING (ts_id, id, ts))""",
)
def e_05(spark, sf):
    seven = clean.to_grid(ev_hour(spark, sf), "7h")
    return rounded(ev_grid(spark, sf).unionByName(od_grid(spark, sf)).unionByName(seven))


@register(
    "e_06_cut_common_span",
    "ev_multi",
    sql="""SELECT ts_id, id, ts, round(value, 4) AS value FROM ev_multi JOIN (
        SELECT ts_id, max(lo) AS lo, min(hi) AS hi FROM (SELECT ts_id, id, min(ts) AS lo, max(ts) AS hi FROM ev_multi GROUP BY 1, 2) GROUP BY 1)
        USING (ts_id) WHERE ts BETWEEN lo AND hi""",
)
def e_06(spark, sf):
    return rounded(clean.cut_common_span(ev_multi(spark, sf)))


part(
    "od_judged",
    """SELECT *, coalesce(abs(value - avg(value) OVER m) > 2 * stddev_samp(value) OVER m, false) AS out FROM od_day
        WINDOW m AS (PARTITION BY ts_id, id, month(ts))""",
    "od_day",
)
part(
    "od_clean",
    """SELECT g.ts_id, g.id, g.ts, s.value FROM (
        SELECT ts_id, id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM od_judged WHERE NOT out GROUP BY 1, 2) g
        LEFT JOIN (SELECT * FROM od_judged WHERE NOT out) s USING (ts_id, id, ts)""",
    "od_judged",
)


@register("e_07_remove_outliers", "od_clean", sql="SELECT ts_id, id, ts, round(value, 4) AS value FROM od_clean")
def e_07(spark, sf):
    return rounded(clean.remove_outliers(od_day(spark, sf), "1d", 2.0))


@register("e_08_outlier_report", "od_judged", sql="SELECT ts_id, id, ts, round(value, 4) AS value FROM od_judged WHERE out")
def e_08(spark, sf):
    return rounded(clean.outlier_report(od_day(spark, sf), 2.0))


@register(
    "e_09_post_gap_spikes",
    "od_grid",
    sql="""SELECT ts_id, id, ts, round(CASE WHEN g AND (value >= cut OR value = 0) THEN NULL ELSE value END, 4) AS value FROM (
        SELECT *, coalesce(lag(value IS NULL) OVER (PARTITION BY ts_id, id ORDER BY ts), false) AS g FROM od_grid)
        LEFT JOIN (SELECT ts_id, id, quantile_cont(value, 0.9) AS cut FROM od_grid GROUP BY 1, 2) USING (ts_id, id)""",
)
def e_09(spark, sf):
    return rounded(clean.remove_post_gap_spikes(od_stored(spark, sf), "1d", 0.9))


part(
    "od_islands",
    """SELECT *, count(*) OVER (PARTITION BY ts_id, id, g, value IS NULL) AS len FROM (
        SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY ts_id, id ORDER BY ts) AS g FROM od_grid)""",
    "od_grid",
)


@register(
    "e_10_short_islands_report",
    "od_islands",
    sql="SELECT ts_id, id, ts, round(value, 4) AS value FROM od_islands WHERE value IS NOT NULL AND len <= 3",
)
def e_10(spark, sf):
    return rounded(clean.short_island_report(od_grid(spark, sf), "1d", 3))


@register(
    "e_11_gap_profile",
    "od_known",
    sql="""SELECT ts_id, id, ts, ts - to_days((fwd - 1)::INTEGER) AS run_start, run_len, least(fwd, run_len - fwd + 1) AS distance
        FROM od_known WHERE value IS NULL""",
)
def e_11(spark, sf):
    return impute.gap_profile(od_grid(spark, sf, True), "1d")


THR = "(value IS NULL AND run_len >= 2 * floor({} / 2) - 1)"


def _fill(method: str, thr: int = -1):
    return lambda spark, sf: mean_rounded(impute.impute(od_grid(spark, sf, True), "1d", method, thr))


def _cubic(method: str):
    def query(spark, sf):
        d = impute.impute(od_stored(spark, sf), "1d", method)
        return mean_rounded(d)

    return query


register("e_12_gap_limit", "od_known", sql=f"SELECT ts_id, id, ts, round({OFF_TIE!r}::DOUBLE + CASE WHEN {THR.format(4)} THEN NULL ELSE {LINE} END, 4) AS value FROM od_known")(
    _fill("linear", 4)
)
register("e_13_impute_linear", "od_known", sql=f"SELECT ts_id, id, ts, round({OFF_TIE!r}::DOUBLE + CASE WHEN {THR.format('n')} THEN NULL ELSE {LINE} END, 4) AS value FROM od_known")(
    _fill("linear")
)
register("e_14_impute_pad", "od_known", sql=f"SELECT ts_id, id, ts, round({OFF_TIE!r}::DOUBLE + CASE WHEN {THR.format('n')} THEN NULL ELSE pv END, 4) AS value FROM od_known")(
    _fill("pad")
)
def _nearest_sql(src: str) -> str:
    """The nearer of two known values, the earlier one at equal distance; gaps at either end stay."""
    return f"""SELECT ts_id, id, ts, round({OFF_TIE!r}::DOUBLE + CASE WHEN value IS NOT NULL THEN value
        WHEN {THR.format('n')} OR pv IS NULL OR nv IS NULL THEN NULL
        WHEN date_diff('second', ts, nt) < date_diff('second', pt, ts) THEN nv ELSE pv END, 4) AS value FROM {src}"""


register("e_15_impute_nearest", "od_known", sql=_nearest_sql("od_known"))(_fill("nearest"))

# the same where a component begins and ends with missing values
part(
    "od_edge",
    """SELECT ts_id, id, ts, CASE WHEN ts BETWEEN lo + INTERVAL 10 DAY AND hi - INTERVAL 10 DAY THEN value END AS value FROM (
        SELECT *, min(ts) OVER (PARTITION BY ts_id, id) AS lo, max(ts) OVER (PARTITION BY ts_id, id) AS hi FROM od_grid)""",
    "od_grid",
)
part("edge_known", known_sql("od_edge"), "od_edge")


def od_edge(spark, sf):
    d = od_grid(spark, sf)
    ends = d.groupBy("ts_id", "id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    inner = F.col("ts").between(F.expr("lo + interval '10' day"), F.expr("hi - interval '10' day"))
    return d.join(ends, ["ts_id", "id"]).select("ts_id", "id", "ts", F.when(inner, F.col("value")).alias("value"))


def _edge(method: str):
    return lambda spark, sf: mean_rounded(impute.impute(od_edge(spark, sf), "1d", method))


register("e_13_linear_at_ends", "edge_known", sql=f"SELECT ts_id, id, ts, round({OFF_TIE!r}::DOUBLE + CASE WHEN {THR.format('n')} THEN NULL ELSE {LINE} END, 4) AS value FROM edge_known")(
    _edge("linear")
)
register("e_14_pad_at_ends", "edge_known", sql=f"SELECT ts_id, id, ts, round({OFF_TIE!r}::DOUBLE + CASE WHEN {THR.format('n')} THEN NULL ELSE pv END, 4) AS value FROM edge_known")(
    _edge("pad")
)
register("e_15_nearest_at_ends", "edge_known", sql=_nearest_sql("edge_known"))(_edge("nearest"))

KNOTS = """SELECT ts_id, id, ts, value, epoch(ts) AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY ts_id, id) AS cnt,
    lead(epoch(ts)) OVER w - epoch(ts) AS h, (lead(value) OVER w - value) / (lead(epoch(ts)) OVER w - epoch(ts)) AS m
    FROM od_grid WHERE value IS NOT NULL WINDOW w AS (PARTITION BY ts_id, id ORDER BY ts)"""
part("od_knots", KNOTS, "od_grid")
part(
    "od_secants",
    """SELECT *, lag(m, 1) OVER w AS m1, lag(m, 2) OVER w AS m2, lead(m, 1) OVER w AS n1, lag(h, 1) OVER w AS h1, lag(h, 2) OVER w AS h2,
        lead(h, 1) OVER w AS k1 FROM od_knots WINDOW w AS (PARTITION BY ts_id, id ORDER BY ts)""",
    "od_knots",
)


def _end(h0, h1, d0, d1):
    raw = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return f"""CASE WHEN sign({raw}) <> sign({d0}) THEN 0.0::DOUBLE
        WHEN sign({d0}) <> sign({d1}) AND abs({raw}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {raw} END"""


part(
    "od_pchip",
    f"""SELECT *, CASE WHEN i = 1 THEN {_end('h', 'k1', 'm', 'n1')} WHEN i = cnt THEN {_end('h1', 'h2', 'm1', 'm2')}
        WHEN m1 * m <= 0 THEN 0.0::DOUBLE
        ELSE (3 * h1 + 3 * h) / ((2 * h + h1) / m1 + (h + 2 * h1) / m) END AS d FROM od_secants""",
    "od_secants",
)
part(
    "od_akima",
    """SELECT *, CASE WHEN abs(c2 - c1) + abs(b1 - b2) <= 1e-9::DOUBLE * greatest(abs(c1), abs(b1)) THEN (c1 + b1) / 2
        ELSE (abs(c2 - c1) * b1 + abs(b1 - b2) * c1) / (abs(c2 - c1) + abs(b1 - b2)) END AS d FROM (
        SELECT *, CASE i WHEN 1 THEN 2 * m - n1 ELSE m1 END AS b1,
            CASE i WHEN 1 THEN 3 * m - 2 * n1 WHEN 2 THEN 2 * m1 - m ELSE m2 END AS b2,
            CASE i WHEN cnt THEN 2 * m1 - m2 ELSE m END AS c1,
            CASE i WHEN cnt THEN 3 * m1 - 2 * m2 WHEN cnt - 1 THEN 2 * m - m1 ELSE n1 END AS c2 FROM od_secants)""",
    "od_secants",
)
PIECE = """SELECT g.ts_id, g.id, g.ts, round({nudge}::DOUBLE + CASE WHEN g.value IS NOT NULL THEN g.value ELSE
        p.value + t * (p.d + t * ((3 * p.m - 2 * p.d - p.e) / p.h + t * (p.d + p.e - 2 * p.m) / (p.h * p.h))) END, 4) AS value
    FROM (SELECT *, epoch(ts) - epoch(pt) AS t FROM od_known) g LEFT JOIN (
        SELECT *, lead(d) OVER (PARTITION BY ts_id, id ORDER BY ts) AS e FROM {knots}) p
    ON p.ts_id = g.ts_id AND p.id = g.id AND p.ts = g.pt"""
register("e_16_impute_pchip", "od_known", "od_pchip", sql=PIECE.format(knots="od_pchip", nudge=OFF_TIE))(_cubic("pchip"))
register("e_16_impute_akima", "od_known", "od_akima", sql=PIECE.format(knots="od_akima", nudge=OFF_TIE))(_cubic("akima"))

part("days_off", """SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE (month(o_orderdate), day(o_orderdate)) IN ((1, 1), (5, 1), (12, 25))""")


def days_off(spark, sf):
    """Fixed-date holidays that occur in the orders."""
    md = F.date_format("o_orderdate", "MM-dd")
    return table(spark, sf, "orders").filter(md.isin("01-01", "05-01", "12-25")).select(F.to_date("o_orderdate").alias("date")).distinct()


def _wn(a: str) -> str:
    return f"""(CASE WHEN {a}.ts::DATE IN (SELECT date FROM days_off) THEN CASE WHEN isodow({a}.ts) = 5 THEN 5 ELSE 6 END
        ELSE isodow({a}.ts) - 1 END + hour({a}.ts) / 24.0::DOUBLE + minute({a}.ts) / 1440.0::DOUBLE)"""


def _apart(c: str, n: str) -> str:
    leap = f"(365 + CASE WHEN year({c}.ts) % 4 = 0 AND (year({c}.ts) % 100 <> 0 OR year({c}.ts) % 400 = 0) THEN 1 ELSE 0 END)"
    x = f"(dayofyear({c}.ts) - dayofyear({n}.ts))"
    return f"least((({x} % {leap}) + {leap}) % {leap}, ((-{x} % {leap}) + {leap}) % {leap})"


CUT = "TIMESTAMP '1999-01-01'"
HISTORY = """SELECT k.ts_id, k.id, k.ts, round(CASE WHEN k.value IS NOT NULL THEN k.value
        ELSE w * lin + (1 - w) * coalesce(hist, lin) END, 4) AS value FROM (
        SELECT *, {line} AS lin, exp(-0.3::DOUBLE * least(fwd, run_len - fwd + 1)) AS w FROM od_known) k
    LEFT JOIN (SELECT n.ts_id, n.id, n.ts, avg(c.value) AS hist FROM od_grid n JOIN od_grid c ON n.ts_id = c.ts_id AND n.id = c.id
        WHERE n.value IS NULL AND c.value IS NOT NULL AND (n.ts >= {cut} OR c.ts < {cut}) AND ({rule}) GROUP BY 1, 2, 3) h
    ON h.ts_id = k.ts_id AND h.id = k.id AND h.ts = k.ts"""
WEEK = f"abs({_wn('c')} - {_wn('n')}) < 0.000694 AND abs(year(c.ts) - year(n.ts)) < 3 AND {_apart('c', 'n')} < 30"


def _history_sql(rule: str) -> str:
    return HISTORY.format(line=LINE, cut=CUT, rule=rule)


@register("e_17_impute_historical", "od_known", "days_off", sql=_history_sql(WEEK))
def e_17(spark, sf):
    return rounded(impute.impute_historical(od_stored(spark, sf), "1d", days_off(spark, sf), cut="19990101"))


@register("e_17_impute_same_clock", "od_known", "days_off", sql=_history_sql(f"({WEEK}) OR {_apart('c', 'n')} < 3"))
def e_17b(spark, sf):
    return rounded(impute.impute_historical(od_stored(spark, sf), "1d", days_off(spark, sf), cut="19990101", same_time_window=3))


@register(
    "e_18_null_short_islands",
    "od_islands",
    sql="SELECT ts_id, id, ts, round(CASE WHEN len > 3 THEN value END, 4) AS value FROM od_islands",
)
def e_18(spark, sf):
    return rounded(clean.remove_short_islands(od_grid(spark, sf), "1d", 3))


@register(
    "e_19_impute_recent",
    "od_known",
    sql=f"""SELECT k.ts_id, k.id, k.ts, round(CASE WHEN k.value IS NOT NULL THEN k.value ELSE w * lin + (1 - w) * hist END, 4) AS value FROM (
        SELECT *, {LINE} AS lin, exp(-0.3::DOUBLE * least(fwd, run_len - fwd + 1)) AS w FROM od_known) k
    LEFT JOIN (SELECT ts_id, id, ts, avg(cv) FILTER (gap <= greatest(5, nearest)) AS hist FROM (
            SELECT n.ts_id, n.id, n.ts, c.value AS cv, dayofyear(n.ts) - dayofyear(c.ts) AS gap,
                min(dayofyear(n.ts) - dayofyear(c.ts)) OVER (PARTITION BY n.ts_id, n.id, n.ts) AS nearest
            FROM od_grid n JOIN od_grid c ON n.ts_id = c.ts_id AND n.id = c.id
            WHERE n.value IS NULL AND c.value IS NOT NULL AND (n.ts >= {CUT} OR c.ts < {CUT})
                AND dayofyear(n.ts) - dayofyear(c.ts) BETWEEN 1 AND 19) GROUP BY 1, 2, 3) h
    ON h.ts_id = k.ts_id AND h.id = k.id AND h.ts = k.ts""",
)
def e_19(spark, sf):
    return rounded(impute.impute_recent(od_stored(spark, sf), "1d", cut="19990101"))


@register(
    "e_20_imputed_report",
    "od_known",
    sql=f"SELECT ts_id, id, ts, {mean_sql(LINE)} AS value FROM od_known WHERE value IS NULL AND pv IS NOT NULL AND NOT {THR.format(4)}",
)
def e_20(spark, sf):
    return mean_rounded(impute.imputed_report(impute.impute(od_grid(spark, sf, True), "1d", "linear", 4, flag=True)))


@register(
    "e_20_null_ranges",
    "od_known",
    sql="""SELECT ts_id, id, min(ts) AS range_start, max(ts) AS range_end, count(*) AS steps FROM od_known WHERE value IS NULL
        GROUP BY ts_id, id, run_no""",
)
def e_20b(spark, sf):
    return impute.null_ranges(od_grid(spark, sf, True), "1d")


BIN = """date_trunc('day', min(ts) OVER (PARTITION BY ts_id, id)) + to_seconds(
    date_diff('second', date_trunc('day', min(ts) OVER (PARTITION BY ts_id, id)), ts) // {s} * {s})"""
AGGREGATES = {
    "averaging": "avg(value)",
    "summation": "CASE WHEN count(value) = count(*) THEN sum(value) END",
    "downsampling": "arg_min(value, ts) FILTER (value IS NOT NULL)",
}


def _resample(name: str, method: str) -> None:
    one = "SELECT ts_id, id, bin AS ts, {a} AS value FROM (SELECT *, {b} AS bin FROM multi_grid) GROUP BY 1, 2, 3"
    sql = " UNION ALL ".join(one.format(a=mean_sql(AGGREGATES[method]), b=BIN.format(s=s)) for s in (18000, 21600))

    @register(name, "multi_grid", sql=sql)
    def query(spark, sf):
        d = multi_grid(spark, sf)
        return mean_rounded(resample.resample(d, "5h", method, "1h").unionByName(resample.resample(d, "6h", method, "1h")))


_resample("e_22_resample_averaging", "averaging")
_resample("e_23_resample_summation", "summation")
_resample("e_24_resample_downsampling", "downsampling")


@register(
    "e_22_resample_two_days",
    "li_day",
    sql=f"SELECT ts_id, id, bin AS ts, {mean_sql('avg(value)')} AS value FROM (SELECT *, {BIN.format(s=172800)} AS bin FROM li_day) GROUP BY 1, 2, 3",
)
def e_22b(spark, sf):
    return mean_rounded(resample.resample(li_day(spark, sf), "2d", "averaging", "1d"))


part("ev_first", "SELECT ts_id, id, date_trunc('hour', ts) AS ts, arg_min(value, row_id) AS value FROM ev_raw GROUP BY 1, 2, 3", "ev_raw")


@register("e_04_dedup_events", "ev_first", sql="SELECT ts_id, id, ts::TIMESTAMP AS ts, round(value, 4) AS value FROM ev_first")
def e_04b(spark, sf):
    d = ev_raw(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rounded(clean.dedup_first(d, "row_id"))
