"""Series derived from the shared tables, in Spark and as SQL, plus the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.durable import new_path, stored
from tidewell.model import canonical
from tidewell.operators.clean import to_grid
from tidewell.operators.impute import impute

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, *parts: str, sql: str | None = None):
    """Register a query; ``parts`` name the SQL building blocks its oracle needs."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_parts(sql, parts)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r(c: Column | str, digits: int = 4) -> Column:
    """Rounded value, so that the order of summation does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# Means of money values often lie halfway between two rounded numbers; both sides move off the tie before rounding.
OFF_TIE = 0.0000031


def mean_r(c: Column | str, digits: int = 4) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + OFF_TIE, digits)


def mean_sql(x: str, digits: int = 4) -> str:
    return f"round({x} + {OFF_TIE!r}::DOUBLE, {digits})"


def mean_rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: mean_r(n, digits) for n in names or ("value",)})


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names or ("value",)})


def ev_raw(spark, sf) -> DataFrame:
    return canonical(table(spark, sf, "events"), "event_type", "event_type", "ts", "value", "event_id")


def _bucket(df: DataFrame, unit: str) -> DataFrame:
    return df.withColumn("ts", F.date_trunc(unit, "ts").cast("timestamp_ntz"))


def ev_hour(spark, sf) -> DataFrame:
    """Hourly sums per event type."""
    d = _bucket(table(spark, sf, "events"), "hour")
    d = d.groupBy(F.col("event_type").alias("ts_id"), "ts").agg(F.sum("value").alias("value"))
    return d.select("ts_id", F.col("ts_id").alias("id"), "ts", "value")


def ev_multi(spark, sf) -> DataFrame:
    """Hourly sums with three components per event type."""
    d = _bucket(table(spark, sf, "events"), "hour")
    part = (F.col("user_id") % 3).cast("string")
    return d.groupBy(F.col("event_type").alias("ts_id"), part.alias("id"), "ts").agg(F.sum("value").alias("value"))


def _daily(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    d = df.withColumn("ts", F.date_trunc("day", ts).cast("timestamp_ntz"))
    d = d.groupBy(F.col(key).alias("ts_id"), "ts").agg(F.sum(value).alias("value"))
    return d.select("ts_id", F.col("ts_id").alias("id"), "ts", "value")


def od_day(spark, sf) -> DataFrame:
    return _daily(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def li_day(spark, sf) -> DataFrame:
    return _daily(table(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", "l_quantity")


def ev_grid(spark, sf, keep_slice: bool = False) -> DataFrame:
    return to_grid(ev_hour(spark, sf), "1h", keep_slice=keep_slice)


def od_grid(spark, sf, keep_slice: bool = False) -> DataFrame:
    return to_grid(od_day(spark, sf), "1d", keep_slice=keep_slice)


def multi_grid(spark, sf, keep_slice: bool = False) -> DataFrame:
    return to_grid(ev_multi(spark, sf), "1h", keep_slice=keep_slice)


def ev_fill(spark, sf) -> DataFrame:
    return impute(ev_grid(spark, sf, True), "1h", "linear")


def od_fill(spark, sf) -> DataFrame:
    return impute(od_grid(spark, sf, True), "1d", "linear")


def multi_fill(spark, sf) -> DataFrame:
    return impute(multi_grid(spark, sf, True), "1h", "linear")


def ev_stored(spark, sf) -> DataFrame:
    """The filled hourly series as a table, for queries that read it several times."""
    return stored(ev_fill(spark, sf), "ev_fill")


def od_stored(spark, sf) -> DataFrame:
    """The daily grid as a table."""
    return stored(od_grid(spark, sf), "od_grid")


def multi_stored(spark, sf) -> DataFrame:
    return stored(multi_fill(spark, sf), "multi_fill")


def as_csv(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Write a table as CSV to the shared folder, for the queries that read CSV."""
    path = new_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


def _grid_sql(src: str, step: str) -> str:
    return f"""
        SELECT g.ts_id, g.id, g.ts, s.value FROM (
            SELECT ts_id, id, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts
            FROM {src} GROUP BY ts_id, id) g
        LEFT JOIN {src} s ON s.ts_id = g.ts_id AND s.id = g.id AND s.ts = g.ts"""


def known_sql(src: str) -> str:
    """Nearest known values and the geometry of gaps."""
    return f"""
        SELECT ts_id, id, ts, value, n, pv, pt, nv, nt, run_no,
            row_number() OVER (PARTITION BY ts_id, id, run_no, value IS NULL ORDER BY ts) AS fwd,
            count(*) OVER (PARTITION BY ts_id, id, run_no, value IS NULL) AS run_len
        FROM (
            SELECT *, count(*) OVER (PARTITION BY ts_id, id) AS n,
                count(value) OVER b AS run_no,
                last_value(value IGNORE NULLS) OVER b AS pv,
                last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS pt,
                first_value(value IGNORE NULLS) OVER f AS nv,
                first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS nt
            FROM {src}
            WINDOW b AS (PARTITION BY ts_id, id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   f AS (PARTITION BY ts_id, id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


LINE = """CASE WHEN value IS NOT NULL THEN value WHEN nt IS NULL THEN pv
    ELSE pv + (nv - pv) * date_diff('second', pt, ts)::DOUBLE / date_diff('second', pt, nt)::DOUBLE END"""


def _fill_sql(src: str) -> str:
    """Linear fill without a limit; only a component without any known value would stay empty."""
    return f"SELECT ts_id, id, ts, {LINE} AS value FROM {src}"


PARTS = {
    "ev_raw": "SELECT event_type AS ts_id, event_type AS id, ts, value, event_id AS row_id FROM events",
    "ev_hour": """SELECT event_type AS ts_id, event_type AS id, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(value) AS value
        FROM events GROUP BY 1, 2, 3""",
    "ev_multi": """SELECT event_type AS ts_id, (user_id % 3)::VARCHAR AS id, date_trunc('hour', ts)::TIMESTAMP AS ts,
        sum(value) AS value FROM events GROUP BY 1, 2, 3""",
    "od_day": """SELECT o_orderpriority AS ts_id, o_orderpriority AS id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
        sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3""",
    "li_day": """SELECT l_returnflag AS ts_id, l_returnflag AS id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
        sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3""",
    "ev_grid": _grid_sql("ev_hour", "1 HOUR"),
    "od_grid": _grid_sql("od_day", "1 DAY"),
    "multi_grid": _grid_sql("ev_multi", "1 HOUR"),
    "ev_known": known_sql("ev_grid"),
    "od_known": known_sql("od_grid"),
    "multi_known": known_sql("multi_grid"),
    "ev_fill": _fill_sql("ev_known"),
    "od_fill": _fill_sql("od_known"),
    "multi_fill": _fill_sql("multi_known"),
}
NEEDS = {
    "ev_grid": ["ev_hour"],
    "od_grid": ["od_day"],
    "multi_grid": ["ev_multi"],
    "ev_known": ["ev_grid"],
    "od_known": ["od_grid"],
    "multi_known": ["multi_grid"],
    "ev_fill": ["ev_known"],
    "od_fill": ["od_known"],
    "multi_fill": ["multi_known"],
}


def part(name: str, sql: str, *needs: str) -> None:
    """Add a building block for oracles."""
    PARTS[name] = sql
    NEEDS[name] = list(needs)


def with_parts(sql: str, parts) -> str:
    done: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in done:
            done.append(name)

    for p in parts:
        visit(p)
    if not done:
        return sql
    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    head = ",\n".join(f"{p} AS MATERIALIZED ({PARTS[p]})" for p in done)
    return f"WITH {head}\n{sql}"
