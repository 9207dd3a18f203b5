"""Queries for reading, writing and converting layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.durable import new_path
from tidewell.sources import layouts, readers

from .base import as_csv, ev_hour, ev_multi, register, rounded, table

TS = "yyyy-MM-dd HH:mm:ss"


@register(
    "s_01_read_single",
    sql="""SELECT 'Timeseries' AS ts_id, 'Timeseries' AS id, date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS value
        FROM events GROUP BY 3""",
)
def s_01(spark, sf):
    total = ev_hour(spark, sf).groupBy("ts").agg(F.sum("value").alias("value"))
    path = as_csv(spark, total.select(F.date_format("ts", TS).alias("Datetime"), F.col("value").alias("Value")), "single")
    return rounded(readers.read_single(spark, path).drop("row_id"))


@register(
    "s_01_single_folder",
    "ev_hour",
    sql="""SELECT 'Timeseries' AS ts_id, 'Timeseries' AS id, ts, round(value, 4) AS value, row_number() OVER (ORDER BY ts) - 1 AS row_id
        FROM ev_hour WHERE ts_id = 'click'""",
)
def s_01_folder(spark, sf):
    """A series in several files, in their order: rows are numbered along all of them."""
    one = ev_hour(spark, sf).filter("ts_id = 'click'").repartitionByRange(5, "ts").sortWithinPartitions("ts")
    path = as_csv(spark, one.select(F.date_format("ts", TS).alias("Datetime"), F.col("value").alias("Value")), "folder")
    return rounded(readers.read_single(spark, path, exact=True))


@register(
    "s_02_read_long",
    "ev_multi",
    sql="""SELECT ts_id, replace(id, '/', '_') AS id, ts, round(value, 4) AS value FROM (
        SELECT ts_id, CASE WHEN id = '1' THEN ts_id || '/' || id ELSE id END AS id, ts, value FROM ev_multi
        UNION ALL SELECT 'x' || id, 'x' || id, ts, value FROM ev_multi WHERE ts_id = 'click')""",
)
def s_02(spark, sf):
    d = ev_multi(spark, sf)
    named = d.withColumn("id", F.when(F.col("id") == "1", F.concat_ws("/", "ts_id", "id")).otherwise(F.col("id")))
    unnamed = d.filter("ts_id = 'click'").select(
        F.lit(None).cast("string").alias("ts_id"), F.concat(F.lit("x"), "id").alias("id"), "ts", "value"
    )
    long = named.unionByName(unnamed).select(
        F.monotonically_increasing_id().alias("index"),
        F.date_format("ts", TS).alias("Datetime"),
        F.col("id").alias("ID"),
        F.col("ts_id").alias("Timeseries ID"),
        F.col("value").alias("Value"),
    )
    return rounded(readers.read_long(spark, as_csv(spark, long, "long")).drop("row_id"))


def _short(spark, sf):
    """Quarter-day sums per (event type, component) in the wide layout."""
    d = table(spark, sf, "events")
    six = F.lpad((F.floor(F.hour("ts") / 6) * 6).cast("string"), 2, "0")
    return (
        d.withColumn("time", F.concat(six, F.lit(":00:00")))
        .groupBy(F.to_date("ts").alias("Date"), (F.col("user_id") % 3).cast("string").alias("ID"), F.col("event_type").alias("Timeseries ID"))
        .pivot("time", layouts.times_of_day(21600))
        .agg(F.sum("value"))
    )


SHORT = """SELECT ts_id, id, ts, round(s.value, 4) AS value FROM (
        SELECT d.ts_id, d.id, d.day + to_hours(h) AS ts, d.day, h FROM (
            SELECT DISTINCT event_type AS ts_id, (user_id % 3)::VARCHAR AS id, date_trunc('day', ts)::TIMESTAMP AS day FROM events) d,
            (VALUES (0), (6), (12), (18)) v(h)) g
        LEFT JOIN (SELECT event_type AS ts_id, (user_id % 3)::VARCHAR AS id, date_trunc('day', ts)::TIMESTAMP AS day,
            (hour(ts) // 6 * 6) AS h, sum(value) AS value FROM events GROUP BY 1, 2, 3, 4) s USING (ts_id, id, day, h)"""


@register("s_03_short_to_long", sql=SHORT)
def s_03(spark, sf):
    return rounded(layouts.short_to_long(_short(spark, sf)))


@register(
    "s_04_write_long",
    "ev_multi",
    sql="""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Datetime", id AS "ID", ts_id AS "Timeseries ID", round(value, 4) AS "Value"
        FROM ev_multi""",
)
def s_04(spark, sf):
    path = new_path(spark, "written")
    readers.write_long(ev_multi(spark, sf), path)
    return rounded(spark.read.parquet(path), "Value")


@register(
    "s_05_long_to_short",
    sql="""SELECT date_trunc('day', ts)::DATE AS "Date", (user_id % 3)::VARCHAR AS "ID", event_type AS "Timeseries ID",
        """
    + ", ".join(f'round(avg(value) FILTER (hour(ts) = {h}), 4) AS "{h:02d}:00:00"' for h in range(24))
    + " FROM events GROUP BY 1, 2, 3",
)
def s_05(spark, sf):
    d = table(spark, sf, "events").select(
        F.col("event_type").alias("ts_id"),
        (F.col("user_id") % 3).cast("string").alias("id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        "value",
    )
    times = layouts.times_of_day(3600)
    return rounded(layouts.long_to_short(d, times), *times)


@register(
    "s_06_unfold_daily",
    sql="""WITH docs AS (SELECT event_type AS ts_id, date_trunc('day', ts)::TIMESTAMP AS day, user_id % 2 AS half, hour(ts) AS h,
            sum(value) AS value FROM events GROUP BY 1, 2, 3, 4),
        kept AS (SELECT ts_id, day, min(half) AS half FROM docs GROUP BY 1, 2)
        SELECT ts_id, ts_id AS id, day + to_hours(h) AS ts, round(value, 4) AS value FROM docs JOIN kept USING (ts_id, day, half)""",
)
def s_06(spark, sf):
    d = table(spark, sf, "events")
    hours = d.groupBy(
        F.col("event_type").alias("source"),
        F.to_date("ts").alias("date"),
        (F.col("user_id") % 2).alias("half"),
        F.date_format("ts", "HH:00:00").alias("time"),
    ).agg(F.sum("value").alias("value"))
    # one document per source, day and half of the users: at most 24 entries
    docs = hours.groupBy("source", "date", "half").agg(F.map_from_entries(F.collect_list(F.struct("time", "value"))).alias("doc"))
    order = F.datediff("date", F.lit("2000-01-01")) * 2 + F.col("half")
    return rounded(layouts.unfold_daily(docs.withColumn("no", order.cast("bigint")), "source", "no"))


@register(
    "s_07_normalise_meter",
    sql="""SELECT day AS "Date", name AS "ID", name AS "Timeseries ID", round(a, 4) AS "00:00:00", round(p, 4) AS "12:00:00" FROM (
        SELECT *, row_number() OVER (PARTITION BY day, name ORDER BY version) AS i FROM (
            SELECT date_trunc('day', ts)::DATE AS day, event_type || ' P' || (user_id % 2)::VARCHAR AS name, user_id % 4 AS version,
                sum(value) FILTER (hour(ts) < 12) AS a, sum(value) FILTER (hour(ts) >= 12) AS p FROM events GROUP BY 1, 2, 3)) WHERE i = 1""",
)
def s_07(spark, sf):
    d = table(spark, sf, "events")
    docs = d.groupBy(
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("id"),
        F.concat(F.lit("P"), (F.col("user_id") % 2).cast("string")).alias("power_type"),
        (F.col("user_id") % 4).alias("version"),
    ).agg(
        F.sum(F.when(F.hour("ts") < 12, F.col("value"))).alias("00:00:00"),
        F.sum(F.when(F.hour("ts") >= 12, F.col("value"))).alias("12:00:00"),
    )
    return rounded(layouts.normalise_meter(docs, "version"), "00:00:00", "12:00:00")


@register(
    "s_10_cleaning_reports",
    "od_day",
    "od_grid",
    sql="""SELECT * FROM (
        SELECT 'removed' AS report, ts_id, count(*) AS n FROM (
            SELECT *, avg(value) OVER m AS mean, stddev_samp(value) OVER m AS sd FROM od_day WINDOW m AS (PARTITION BY ts_id, id, month(ts)))
        WHERE abs(value - mean) > 2 * sd GROUP BY ts_id
        UNION ALL SELECT 'imputed', ts_id, count(*) FROM od_grid WHERE value IS NULL GROUP BY ts_id)""",
)
def s_10(spark, sf):
    from tidewell.operators.clean import outlier_report
    from tidewell.operators.impute import impute, imputed_report

    from .base import od_day, od_grid

    filled = impute(od_grid(spark, sf, True), "1d", "linear", flag=True)
    tables = {"removed": outlier_report(od_day(spark, sf), 2.0), "imputed": imputed_report(filled)}
    written = readers.write_tables(tables, new_path(spark, "reports"), by="ts_id")
    # names of folders are read as the text they are, not as numbers or dates
    read = {k: spark.read.schema(tables[k].schema).parquet(p) for k, p in written.items()}
    out = [d.groupBy("ts_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("report"), "ts_id", "n") for k, d in read.items()]
    return out[0].unionByName(out[1])
