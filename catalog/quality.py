"""Queries for the data-quality rules and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.model import canonical
from tidewell.operators import prep, profile, quality
from tidewell.sources.layouts import clean_ids

from .base import ev_grid, ev_hour, ev_multi, ev_raw, od_day, od_grid, part, register, table

COLS = ["rule", "ts_id", "id", "row_id", "detail"]
part(
    "ev_text",
    """SELECT event_id::VARCHAR AS row_id, event_type AS ts_id,
        CASE WHEN event_id % 83 = 3 THEN '1.5' ELSE event_type || '/' || (user_id % 2)::VARCHAR END AS id,
        CASE WHEN event_id % 97 = 5 THEN strftime(ts, '%d-%m-%Y %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw_ts,
        CASE WHEN event_id % 89 = 7 THEN 'abc' ELSE value::VARCHAR END AS raw_value, ts, value FROM events""",
)
part("ev_dup", "SELECT event_type AS ts_id, event_type AS id, date_trunc('hour', ts)::TIMESTAMP AS ts, value, event_id AS row_id FROM events")


def ev_text(spark, sf):
    """Events as text with wrong dates, wrong values and wrong identifiers mixed in."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(
        k.cast("string").alias("row_id"),
        F.col("event_type").alias("ts_id"),
        F.when(k % 83 == 3, "1.5").otherwise(F.concat_ws("/", "event_type", (F.col("user_id") % 2).cast("string"))).alias("id"),
        F.when(k % 97 == 5, F.date_format("ts", "dd-MM-yyyy HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("raw_ts"),
        F.when(k % 89 == 7, "abc").otherwise(F.col("value").cast("string")).alias("raw_value"),
    )


def ev_dup(spark, sf):
    return ev_raw(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


@register("v_01_empty", sql="SELECT 'V-01' AS rule, NULL::VARCHAR AS ts_id, NULL::VARCHAR AS id, NULL::BIGINT AS row_id, n::VARCHAR AS detail FROM (SELECT count(*) AS n FROM events WHERE value IS NULL) WHERE n < 1")
def v_01(spark, sf):
    # the rows without a value: an empty table, whatever the size of the input
    return quality.v_empty(table(spark, sf, "events").filter("value is null"))


@register(
    "v_02_columns",
    sql="""SELECT 'events' AS source, 'expected Datetime, Value; got [' || string_agg(chr(39) || c || chr(39), ', ' ORDER BY i) || ']' AS problem
        FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS c, unnest(range(6)) AS i)""",
)
def v_02(spark, sf):
    problems = quality.v_columns(table(spark, sf, "events").columns, "single")
    return spark.createDataFrame([("events", p) for p in problems], "source string, problem string")


@register("v_03_date_format", "ev_text", sql="SELECT 'V-03' AS rule, ts_id, id, row_id::BIGINT AS row_id, raw_ts AS detail FROM ev_text WHERE raw_ts NOT LIKE '____-__-__ __:__:__'")
def v_03(spark, sf):
    return quality.v_date_format(ev_text(spark, sf))


@register("v_04_value_type", "ev_text", sql="SELECT 'V-04' AS rule, ts_id, id, row_id::BIGINT AS row_id, raw_value AS detail FROM ev_text WHERE raw_value IS NOT NULL AND try_cast(raw_value AS DOUBLE) IS NULL")
def v_04(spark, sf):
    return quality.v_value_type(ev_text(spark, sf))


@register("v_05_id_not_float", "ev_text", sql=r"SELECT 'V-05' AS rule, ts_id, id, row_id::BIGINT AS row_id, ts_id || ' ' || id AS detail FROM ev_text WHERE regexp_full_match(id, '\d+\.\d+') OR regexp_full_match(ts_id, '\d+\.\d+')")
def v_05(spark, sf):
    return quality.v_id_not_float(ev_text(spark, sf))


@register("v_06_clean_ids", "ev_text", sql="SELECT ts_id, replace(id, '/', '_') AS id, count(*) AS n FROM ev_text GROUP BY 1, 2")
def v_06(spark, sf):
    return clean_ids(ev_text(spark, sf)).groupBy("ts_id", "id").agg(F.count("*").alias("n"))


@register(
    "v_07_duplicates",
    "ev_dup",
    sql="""SELECT 'V-07' AS rule, ts_id, id, row_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS detail FROM (
        SELECT *, row_number() OVER (PARTITION BY ts_id, id, ts ORDER BY row_id) AS i FROM ev_dup) WHERE i > 1""",
)
def v_07(spark, sf):
    return quality.v_duplicates(ev_dup(spark, sf))


@register(
    "v_08_order",
    sql="""SELECT 'V-08' AS rule, o_orderpriority AS ts_id, o_orderpriority AS id, o_orderkey AS row_id,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS detail FROM (
        SELECT *, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders) WHERE o_orderdate < p""",
)
def v_08(spark, sf):
    o = table(spark, sf, "orders")
    return quality.v_order(canonical(o, "o_orderpriority", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"))


V09 = """WITH h AS (SELECT DISTINCT o_orderkey + o_orderkey // 7 AS i FROM orders), n AS (SELECT count(*) AS n FROM orders)
    SELECT 'V-09' AS rule, NULL::VARCHAR AS ts_id, NULL::VARCHAR AS id, i AS row_id, 'missing' AS detail
    FROM (SELECT i + 1 AS i FROM h UNION ALL SELECT 0) c, n WHERE i >= 0 AND i < n AND i NOT IN (SELECT i FROM h)"""


@register("v_09_index", sql=V09)
def v_09(spark, sf):
    raw = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + F.floor(F.col("o_orderkey") / 7)).cast("string").alias("row_id"), F.lit("o").alias("ts_id"), F.lit("o").alias("id")
    )
    return quality.v_index(raw).distinct()


@register(
    "v_10_components",
    sql="""SELECT 'V-10' AS rule, ts_id, NULL::VARCHAR AS id, NULL::BIGINT AS row_id, n::VARCHAR AS detail FROM (
        SELECT ts_id, n, max(n) OVER () - min(n) OVER () AS d FROM (
            SELECT o_orderpriority AS ts_id, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)) WHERE d > 0""",
)
def v_10(spark, sf):
    o = table(spark, sf, "orders")
    return quality.v_components(o.select(F.col("o_orderpriority").alias("ts_id"), F.col("o_custkey").cast("string").alias("id")))


@register(
    "v_11_too_short",
    sql="""SELECT 'V-11' AS rule, o_orderpriority AS ts_id, o_custkey::VARCHAR AS id, NULL::BIGINT AS row_id, count(o_totalprice)::VARCHAR AS detail
        FROM orders GROUP BY 2, 3 HAVING count(o_totalprice) < 2""",
)
def v_11(spark, sf):
    o = table(spark, sf, "orders")
    return quality.v_too_short(
        o.select(F.col("o_orderpriority").alias("ts_id"), F.col("o_custkey").cast("string").alias("id"), F.col("o_totalprice").alias("value"))
    )


part("mixed", "SELECT * FROM ev_hour UNION ALL SELECT * FROM od_day", "ev_hour", "od_day")
STEPS = """SELECT ts_id, id, min(date_diff('second', p, ts)) AS seconds FROM (
    SELECT *, lag(ts) OVER (PARTITION BY ts_id, id ORDER BY ts) AS p FROM {src}) GROUP BY 1, 2"""
part("mixed_res", STEPS.format(src="mixed"), "mixed")
LABEL = """CASE WHEN seconds % 86400 = 0 THEN (seconds // 86400)::VARCHAR || 'd' WHEN seconds % 3600 = 0 THEN (seconds // 3600)::VARCHAR || 'h'
    WHEN seconds % 60 = 0 THEN (seconds // 60)::VARCHAR || 'min' ELSE seconds::VARCHAR || 's' END"""


def mixed(spark, sf):
    return ev_hour(spark, sf).unionByName(od_day(spark, sf))


@register(
    "v_12_resolution",
    "mixed_res",
    sql=f"""SELECT 'V-12' AS rule, ts_id, id, NULL::BIGINT AS row_id, {LABEL} AS detail FROM (
        SELECT *, max(seconds) OVER () - min(seconds) OVER () AS d FROM mixed_res) WHERE d > 0""",
)
def v_12(spark, sf):
    return quality.v_resolution(mixed(spark, sf))


@register(
    "v_13_ends_before_val",
    sql="""SELECT 'V-13' AS rule, event_type AS ts_id, user_id::VARCHAR AS id, NULL::BIGINT AS row_id,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS detail FROM events GROUP BY 2, 3 HAVING max(ts) < TIMESTAMP '2024-01-28 00:00:00'""",
)
def v_13(spark, sf):
    e = table(spark, sf, "events")
    return quality.v_ends_before_val(e.select(F.col("event_type").alias("ts_id"), F.col("user_id").cast("string").alias("id"), "ts"), "20240128")


@register(
    "v_14_nulls_after_val",
    "od_grid",
    sql="""SELECT 'V-14' AS rule, ts_id, id, NULL::BIGINT AS row_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS detail FROM od_grid
        WHERE ts >= TIMESTAMP '2000-01-01' AND value IS NULL GROUP BY 2, 3""",
)
def v_14(spark, sf):
    return quality.v_nulls_after_val(od_grid(spark, sf), "20000101")


SPLIT = "CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' WHEN ts < TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END"


@register(
    "v_15_nan_in_set",
    "ev_grid",
    sql=f"""SELECT 'V-15' AS rule, ts_id, id, NULL::BIGINT AS row_id, {SPLIT} || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS detail
        FROM ev_grid WHERE value IS NULL AND ts >= TIMESTAMP '2024-01-15'""",
)
def v_15(spark, sf):
    return quality.v_nan_in_set(prep.split(ev_grid(spark, sf), "20240115", "20240122"))


@register(
    "v_18_series_exists",
    "ev_hour",
    sql="""SELECT 'V-18' AS rule, w AS ts_id, NULL::VARCHAR AS id, NULL::BIGINT AS row_id, 'unknown series' AS detail
        FROM (VALUES ('click'), ('nowhere'), ('purchase')) v(w) WHERE w NOT IN (SELECT ts_id FROM ev_hour)""",
)
def v_18(spark, sf):
    return quality.v_series_exists(ev_hour(spark, sf), ["click", "nowhere", "purchase"])


@register(
    "v_19_drop_empty",
    sql="""WITH s AS (SELECT o_custkey::VARCHAR AS ts_id, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS value FROM orders)
        SELECT ts_id, count(*) AS n FROM s GROUP BY 1 HAVING count(value) > 0""",
)
def v_19(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(
        F.col("o_custkey").cast("string").alias("ts_id"), F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("value")
    )
    return quality.drop_empty(s).groupBy("ts_id").agg(F.count("*").alias("n"))


@register("i_01_infer_resolution", "mixed_res", sql=f"SELECT ts_id, id, seconds, {LABEL} AS resolution FROM mixed_res")
def i_01(spark, sf):
    return profile.infer_resolution(mixed(spark, sf))


@register(
    "i_03_allowed_resolutions",
    "mixed_res",
    sql=f"""SELECT ts_id, id, seconds, is_default, {LABEL} AS resolution FROM (
        SELECT ts_id, id, seconds, TRUE AS is_default FROM mixed_res UNION ALL
        SELECT ts_id, id, s, FALSE FROM mixed_res, (VALUES {", ".join(f"({s}::BIGINT)" for s, _ in profile.LADDER)}) v(s) WHERE s > seconds)""",
)
def i_03(spark, sf):
    return profile.allowed_resolutions(mixed(spark, sf))


@register(
    "i_04_dataset_span",
    "ev_multi",
    sql='SELECT ts_id, min(ts) AS start, max(ts) AS "end", min(ts) + INTERVAL 10 DAY AS first_val FROM ev_multi GROUP BY 1',
)
def i_04(spark, sf):
    return profile.dataset_span(ev_multi(spark, sf))
