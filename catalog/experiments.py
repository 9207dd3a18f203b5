"""Queries for what a whole experiment reports beside its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.durable import new_path
from tidewell.plans.experiment import Experiment, run_experiment
from tidewell.plans.preparation import Preparation, prepare_reported
from tidewell.sources import readers

from .base import LINE, ev_multi, known_sql, mean_rounded, mean_sql, part, register
from .flagship import START
from .forecasting import START_SQL, VAL, VAL_SQL, H

part(
    "xm_judged",
    """SELECT ts_id, id, ts, value, coalesce(abs(value - mean) > 2::DOUBLE * sd, false) AS out FROM (
        SELECT *, avg(value) OVER m AS mean, stddev_samp(value) OVER m AS sd FROM ev_multi WINDOW m AS (PARTITION BY ts_id, id, month(ts)))""",
    "ev_multi",
)
part(
    "xm_clean",
    """SELECT g.ts_id, g.id, g.ts, s.value FROM (
        SELECT ts_id, id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM xm_judged WHERE NOT out GROUP BY 1, 2) g
        LEFT JOIN (SELECT * FROM xm_judged WHERE NOT out) s USING (ts_id, id, ts)""",
    "xm_judged",
)
part("xm_known", known_sql("xm_clean"), "xm_clean")
part("xm_fill", f"SELECT ts_id, id, ts, value IS NULL AS was, CASE WHEN value IS NULL AND run_len >= 3 THEN NULL ELSE {LINE} END AS value FROM xm_known", "xm_known")
part(
    "xm_islands",
    """SELECT *, count(*) OVER (PARTITION BY ts_id, id, g, value IS NULL) AS len FROM (
        SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY ts_id, id ORDER BY ts) AS g FROM xm_fill)""",
    "xm_fill",
)
part("xm_final", "SELECT ts_id, id, ts, CASE WHEN len > 2 THEN value END AS value FROM xm_islands", "xm_islands")


@register(
    "s_10_preparation_reports",
    "xm_final",
    sql=f"""SELECT 'outliers' AS report, ts_id, id, count(*) AS n, {mean_sql('sum(value)', 2)} AS total FROM xm_judged WHERE out GROUP BY 2, 3
        UNION ALL SELECT 'imputed', ts_id, id, count(*), {mean_sql('sum(value)', 2)} FROM xm_fill WHERE was AND value IS NOT NULL GROUP BY 2, 3
        UNION ALL SELECT 'short_islands', ts_id, id, count(*), {mean_sql('sum(value)', 2)} FROM xm_islands WHERE value IS NOT NULL AND len <= 2 GROUP BY 2, 3
        UNION ALL SELECT 'residual_ranges', ts_id, id, count(*) FILTER (new), {mean_sql('count(*)::DOUBLE', 2)} FROM (
            SELECT *, coalesce(lag(value IS NOT NULL) OVER (PARTITION BY ts_id, id ORDER BY ts), true) AS new FROM xm_final) WHERE value IS NULL GROUP BY 2, 3""",
)
def s_10_reports(spark, sf):
    """Everything a preparation removes, fills and leaves missing, written and read again."""
    plan = Preparation("1h", std_dev=2.0, max_thr=4, min_island=2)
    _, reports = prepare_reported(ev_multi(spark, sf).withColumn("row_id", F.lit(0)), plan)
    written = readers.write_tables(reports, new_path(spark, "reports"))
    out = None
    for name, path in written.items():
        d = spark.read.parquet(path)
        total = F.sum("steps").cast("double") if name == "residual_ranges" else F.sum("value")
        d = d.groupBy("ts_id", "id").agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(F.lit(name).alias("report"), "*")
        out = d if out is None else out.unionByName(d)
    return mean_rounded(out, "total", digits=2)


@register(
    "s_11_actuals_and_scaled",
    "fc_plan",
    sql=f"""WITH sc AS (SELECT ts_id, id, min(value) AS lo, max(value) AS hi FROM multi_cut WHERE ts < {VAL_SQL} GROUP BY 1, 2)
        SELECT 'actuals' AS output, ts_id, id, count(*) AS n, {mean_sql('sum(value)', 2)} AS total FROM multi_cut WHERE ts >= {START_SQL} GROUP BY 2, 3
        UNION ALL SELECT 'scaled_forecasts', f.ts_id, f.id, count(*), {mean_sql('sum((yhat - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END)', 3)}
            FROM fc_plan f JOIN sc ON sc.ts_id = f.ts_id AND sc.id = f.id GROUP BY 2, 3
        UNION ALL SELECT 'scaler', ts_id, id, 1, {mean_sql('hi - lo', 3)} FROM sc""",
)
def s_11_outputs(spark, sf):
    raw = ev_multi(spark, sf).withColumn("row_id", F.lit(0))
    got = run_experiment(raw, Experiment(Preparation("1h", std_dev=None), VAL, START, horizon=H, strict=True))
    got["scaler"] = got["scaler"].withColumn("width", F.col("hi") - F.col("lo"))
    column = {"actuals": ("value", 2), "scaled_forecasts": ("yhat", 3), "scaler": ("width", 3)}
    written = readers.write_tables({k: got[k] for k in column}, new_path(spark, "outputs"))
    out = None
    for name, path in written.items():
        c, digits = column[name]
        d = spark.read.parquet(path).groupBy("ts_id", "id").agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"))
        d = mean_rounded(d, "total", digits=digits).select(F.lit(name).alias("output"), "*")
        out = d if out is None else out.unionByName(d)
    return out


@register(
    "v_13_to_15_of_experiment",
    "xm_final",
    sql=f"""SELECT 'V-13' AS rule, ts_id, id, NULL::BIGINT AS row_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS detail FROM xm_final GROUP BY 2, 3 HAVING max(ts) < {VAL_SQL}
        UNION ALL SELECT 'V-14', ts_id, id, NULL, strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM xm_final WHERE ts >= {VAL_SQL} AND value IS NULL GROUP BY 2, 3
        UNION ALL SELECT 'V-15', ts_id, id, NULL, CASE WHEN ts < {START_SQL} THEN 'val ' ELSE 'test ' END || strftime(ts, '%Y-%m-%d %H:%M:%S') FROM xm_final WHERE ts >= {VAL_SQL} AND value IS NULL""",
)
def experiment_rules(spark, sf):
    raw = ev_multi(spark, sf).withColumn("row_id", F.lit(0))
    plan = Preparation("1h", std_dev=2.0, max_thr=4, min_island=2)
    return run_experiment(raw, Experiment(plan, VAL, START, horizon=H, common_span=False))["violations"].drop("order")
