"""Queries for lag features, forecasters, backtests and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.durable import new_path, stored
from tidewell.models import ar, features, naive, paths, trees
from tidewell.operators import prep
from tidewell.operators.covariates import attach_covariates
from tidewell.plans import backtest
from tidewell.plans.backtest import METRICS
from tidewell.plans.experiment import Experiment, run_experiment
from tidewell.plans.preparation import Preparation
from tidewell.sources import readers

from .base import (
    ev_grid,
    ev_multi,
    ev_stored,
    mean_rounded,
    mean_sql,
    multi_stored,
    od_fill,
    part,
    register,
    rounded,
)
from .flagship import START, flagship

VAL, H = "20240115", 24
START_SQL, VAL_SQL = "TIMESTAMP '2024-01-22'", "TIMESTAMP '2024-01-15'"
W = "OVER (PARTITION BY ts_id, id ORDER BY ts)"


def _shown(*names: str) -> str:
    return ", ".join(f"{mean_sql(c)} AS {c}" for c in names)


@register(
    "m_01_lag_features",
    "ev_grid",
    "ev_multi",
    sql=f"""SELECT ts_id, id, ts, round(value, 4) AS value, round(c, 4) AS c, round(lag(value, 1) {W}, 4) AS lag_1, round(lag(value, 2) {W}, 4) AS lag_2,
        round(lag(value, 24) {W}, 4) AS lag_24, round(lag(c, 1) {W}, 4) AS c_lag_1, round(lag(c, 2) {W}, 4) AS c_lag_2, round(g, 4) AS g, round(lag(g, 1) {W}, 4) AS g_lag_1,
        round(lag(f, 1) {W}, 4) AS f_lag_1, round(f, 4) AS f_lead_0, round(lead(f, 1) {W}, 4) AS f_lead_1, round(f, 4) AS f FROM (
        SELECT g.*, a.value AS c, b.value AS f, k.value AS g FROM ev_grid g LEFT JOIN (SELECT * FROM ev_multi WHERE id = '2') k ON k.ts_id = g.ts_id AND k.ts = g.ts LEFT JOIN (SELECT * FROM ev_multi WHERE id = '0') a ON a.ts_id = g.ts_id AND a.ts = g.ts
        LEFT JOIN (SELECT * FROM ev_multi WHERE id = '1') b ON b.ts_id = g.ts_id AND b.ts = g.ts)""",
)
def m_01(spark, sf):
    d = attach_covariates(ev_grid(spark, sf), ev_multi(spark, sf), ["0", "1", "2"]).withColumnsRenamed({"0": "c", "1": "f", "2": "g"})
    out = features.lag_features(d, "1h", [1, 2, 24], past={"c": 2, "g": 1}, future={"f": (1, 2)})
    return rounded(out, *[c for c in out.columns if c not in ("ts_id", "id", "ts")])


@register(
    "m_02_multi_step_targets",
    "ev_grid",
    sql=f"""SELECT ts_id, id, ts, round(value, 4) AS y_0, {', '.join(f'round(lead(value, {k}) {W}, 4) AS y_{k}' for k in range(1, 6))} FROM ev_grid""",
)
def m_02(spark, sf):
    return rounded(features.multi_step_targets(ev_grid(spark, sf), "1h", 6), *[f"y_{k}" for k in range(6)])


def _naive_sql(src: str, start: str, h: int, stride: int, days: str, where: str = "") -> str:
    """Forecasts of the seasonal naive for every row of ``days(days)``."""
    return f"""SELECT d.days, f.ts_id, f.id, f.origin, f.step, f.ts, s.value AS yhat FROM (
            SELECT ts_id, id, origin, step::INTEGER AS step, origin + to_hours((step - 1)::INTEGER) AS ts FROM (
                SELECT ts_id, id, origin, unnest(range(1, {h + 1})) AS step FROM (
                    SELECT ts_id, id, unnest(generate_series(min(ts) FILTER (ts >= {start}), max(ts) - INTERVAL {h - 1} HOUR, INTERVAL {stride} HOUR)) AS origin
                    FROM {src} {where} GROUP BY 1, 2))) f CROSS JOIN ({days}) d
        LEFT JOIN {src} s ON s.ts_id = f.ts_id AND s.id = f.id
            AND s.ts = f.ts - to_hours((24 * d.days * ceil(f.step / (24.0::DOUBLE * d.days)))::INTEGER)"""


ONE, THREE = "SELECT 1 AS days", "SELECT unnest([1, 2, 7]) AS days"
part("fc_day", _naive_sql("ev_fill", START_SQL, H, H, ONE), "ev_fill")
part("fc_overlap", _naive_sql("ev_fill", START_SQL, 30, 6, ONE), "ev_fill")
part("fc_multi", _naive_sql("multi_fill", START_SQL, H, H, ONE), "multi_fill")
part("fc_trials", _naive_sql("ev_fill", START_SQL, H, H, THREE), "ev_fill")
part("ev_before", f"SELECT * FROM ev_fill WHERE ts < {START_SQL}", "ev_fill")
part("fc_val", _naive_sql("ev_before", VAL_SQL, H, H, THREE), "ev_before")


def fc_day(d):
    return naive.seasonal_naive(d, "1h", 1, START, H)


def fc_overlap(d):
    return naive.seasonal_naive(d, "1h", 1, START, 30, 6)


@register("m_03_seasonal_naive", "fc_overlap", sql=f"SELECT ts_id, id, origin, step, ts, {_shown('yhat')} FROM fc_overlap")
def m_03(spark, sf):
    return mean_rounded(fc_overlap(ev_stored(spark, sf)), "yhat")


def full(metric: str) -> str:
    """NULL where a forecast is missing."""
    return f"CASE WHEN count(f.yhat) = count(*) THEN {metric} END"


def _components(actual: str, fc: str, start: str, h: int, stride: int, m: int = 1) -> str:
    """Metrics per (days, component)."""
    begin = f"({start} + INTERVAL {h - stride} HOUR)"
    return f"""SELECT e.*, rmse / nullif(hi - lo, 0) AS nrmse_min_max, rmse / nullif(mean, 0) AS nrmse_mean,
            CASE WHEN lo > 0 AND fmin > 0 THEN 100 * ape END AS mape, mae / nullif(scale, 0) AS mase,
            CASE WHEN size <> 0 THEN 200 * sape END AS smape
        FROM (SELECT f.days, f.ts_id, f.id, {full('avg(abs(a.value - f.yhat))')} AS mae, {full('sqrt(avg((a.value - f.yhat) * (a.value - f.yhat)))')} AS rmse,
                {full('avg(abs((a.value - f.yhat) / nullif(a.value, 0)))')} AS ape, {full('avg(abs(a.value - f.yhat) / nullif(abs(a.value) + abs(f.yhat), 0))')} AS sape,
                min(abs(a.value) + abs(f.yhat)) AS size, min(f.yhat) AS fmin
            FROM {fc} f JOIN {actual} a ON a.ts_id = f.ts_id AND a.id = f.id AND a.ts = f.ts
            WHERE f.step > {h - stride} AND a.ts >= {begin} GROUP BY 1, 2, 3) e
        JOIN (SELECT ts_id, id, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM {actual} WHERE ts >= {begin} GROUP BY 1, 2) t USING (ts_id, id)
        LEFT JOIN (SELECT ts_id, id, avg(abs(value - p)) AS scale FROM (
            SELECT *, lag(value, {m}) OVER (PARTITION BY ts_id, id ORDER BY ts) AS p FROM {actual} WHERE ts < {begin}) GROUP BY 1, 2) s USING (ts_id, id)"""


def _series(src: str) -> str:
    lax = ("nrmse_min_max", "nrmse_mean")
    cols = ", ".join(f"CASE WHEN count({'rmse' if c in lax else c}) = count(*) THEN avg({c}) END AS {c}" for c in METRICS)
    return f"SELECT days, ts_id, {cols} FROM {src} GROUP BY 1, 2"


part("cm_day", _components("ev_fill", "fc_day", START_SQL, H, H), "fc_day")
part("cm_overlap", _components("ev_fill", "fc_overlap", START_SQL, 30, 6, 24), "fc_overlap")
part("cm_multi", _components("multi_fill", "fc_multi", START_SQL, H, H), "fc_multi")
part("cm_val", _components("ev_before", "fc_val", VAL_SQL, H, H), "fc_val")
part("sm_multi", _series("cm_multi"), "cm_multi")
part("sm_val", _series("cm_val"), "cm_val")


@register(
    "b_01_origins",
    "ev_multi",
    sql=f"""SELECT ts_id, id, unnest(generate_series(min(ts) FILTER (ts >= {START_SQL}), max(ts) - INTERVAL 23 HOUR, INTERVAL 6 HOUR)) AS origin
        FROM ev_multi GROUP BY 1, 2""",
)
def b_01(spark, sf):
    return backtest.origins(ev_multi(spark, sf), "1h", START, H, 6)


@register("b_02_merge_windows", "fc_overlap", sql=f"SELECT ts_id, id, origin, step, ts, {_shown('yhat')} FROM fc_overlap WHERE step > 24")
def b_02(spark, sf):
    return mean_rounded(backtest.merge_windows(fc_overlap(ev_stored(spark, sf)), 30, 6), "yhat")


@register(
    "b_03_aligned_actuals",
    "fc_overlap",
    sql=f"""SELECT f.ts_id, f.id, f.ts, {mean_sql('a.value')} AS value, {mean_sql('f.yhat')} AS yhat FROM fc_overlap f
        JOIN ev_fill a ON a.ts_id = f.ts_id AND a.id = f.id AND a.ts = f.ts WHERE step > 24 AND a.ts >= {START_SQL} + INTERVAL 24 HOUR""",
)
def b_03(spark, sf):
    series = ev_stored(spark, sf)
    merged = backtest.merge_windows(fc_overlap(series), 30, 6)
    actual = series.filter(F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz"))
    d = merged.select("ts_id", "id", "ts", "yhat").join(actual, ["ts_id", "id", "ts"])
    return mean_rounded(d, "value", "yhat")


def _metric_query(name: str, *metrics: str) -> None:
    @register(name, "cm_day", "cm_overlap", sql=" UNION ALL ".join(f"SELECT '{k}' AS windows, ts_id, id, {_shown(*metrics)} FROM {k}" for k in ("cm_day", "cm_overlap")))
    def query(spark, sf):
        d = ev_stored(spark, sf)
        day = backtest.component_metrics(d, fc_day(d), "1h", START, H)
        over = backtest.component_metrics(d, backtest.merge_windows(fc_overlap(d), 30, 6), "1h", START, 30, 6, 24)
        both = day.select(F.lit("cm_day").alias("windows"), "*").unionByName(over.select(F.lit("cm_overlap").alias("windows"), "*"))
        return mean_rounded(both.select("windows", "ts_id", "id", *metrics), *metrics)


_metric_query("b_04_mae_rmse", "mae", "rmse")
_metric_query("b_05_nrmse", "nrmse_min_max", "nrmse_mean")
_metric_query("b_06_mape", "mape")
_metric_query("b_07_smape", "smape")
_metric_query("b_08_mase", "mase")


def _per_series(spark, sf):
    d = multi_stored(spark, sf)
    return backtest.evaluate(d, fc_day(d), "1h", START, H)


@register("b_09_metrics_by_series", "sm_multi", sql=f"SELECT ts_id, {_shown(*METRICS)} FROM sm_multi")
def b_09(spark, sf):
    return mean_rounded(_per_series(spark, sf), *METRICS)


@register("b_10_metrics_macro", "sm_multi", sql="SELECT " + ", ".join(f"{mean_sql(f'avg({c})')} AS {c}" for c in METRICS) + " FROM sm_multi")
def b_10(spark, sf):
    return mean_rounded(backtest.metrics_macro(_per_series(spark, sf)), *METRICS)


@register(
    "b_11_eval_target",
    "ev_multi",
    sql="""SELECT 'ts_id' AS method, ts_id, id, count(*) AS n FROM ev_multi WHERE ts_id = 'click' GROUP BY 1, 2, 3
        UNION ALL SELECT 'id', ts_id, id, count(*) FROM ev_multi WHERE id = '1' AND ts_id = (SELECT max(ts_id) FROM ev_multi WHERE id = '1') GROUP BY 1, 2, 3""",
)
def b_11(spark, sf):
    d = ev_multi(spark, sf)
    out = [
        backtest.eval_target(d, how, name).groupBy("ts_id", "id").agg(F.count("*").alias("n")).select(F.lit(how).alias("method"), "*")
        for how, name in (("ts_id", "click"), ("id", "1"))
    ]
    return out[0].unionByName(out[1])


@register("b_12_validate_model", "sm_val", sql=f"SELECT ts_id, {_shown(*METRICS)} FROM sm_val WHERE days = 1")
def b_12(spark, sf):
    known = prep.split(ev_stored(spark, sf), VAL, START).filter("split <> 'test'").drop("split")
    fc = naive.seasonal_naive(known, "1h", 1, VAL, H)
    return mean_rounded(backtest.evaluate(known, fc, "1h", VAL, H), *METRICS)


@register(
    "s_11_evaluation_outputs",
    "sm_multi",
    sql=f"""SELECT 'metrics' AS output, ts_id, count(mae) AS n, {mean_sql('sum(mae)')} AS total FROM sm_multi GROUP BY 2
        UNION ALL SELECT 'predictions', ts_id, count(yhat), {mean_sql('sum(yhat)')} FROM fc_multi GROUP BY 2""",
)
def s_11(spark, sf):
    d = multi_stored(spark, sf)
    fc = stored(fc_day(d), "forecasts")
    tables = {"metrics": backtest.evaluate(d, fc, "1h", START, H), "predictions": fc}
    written = readers.write_tables(tables, new_path(spark, "evaluation"))
    column = {"metrics": "mae", "predictions": "yhat"}
    out = [
        spark.read.parquet(p).groupBy("ts_id").agg(F.count(column[k]).alias("n"), F.sum(column[k]).alias("total")).select(F.lit(k).alias("output"), "*")
        for k, p in written.items()
    ]
    return mean_rounded(out[0].unionByName(out[1]), "total")


part(
    "multi_cut",
    """SELECT m.* FROM multi_fill m JOIN (SELECT ts_id, max(lo) AS lo, min(hi) AS hi FROM (
        SELECT ts_id, id, min(ts) AS lo, max(ts) AS hi FROM multi_fill GROUP BY 1, 2) GROUP BY 1) c ON c.ts_id = m.ts_id AND m.ts BETWEEN lo AND hi""",
    "multi_fill",
)
part("fc_plan", _naive_sql("multi_cut", START_SQL, H, H, ONE), "multi_cut")
part("cm_plan", _components("multi_cut", "fc_plan", START_SQL, H, H), "fc_plan")
part("sm_plan", _series("cm_plan"), "cm_plan")


@register("b_13_experiment", "sm_plan", sql=f"SELECT ts_id, {_shown(*METRICS)} FROM sm_plan")
def b_13(spark, sf):
    plan = Experiment(Preparation("1h", std_dev=None), VAL, START, horizon=H)
    raw = ev_multi(spark, sf).withColumn("row_id", F.lit(0))
    return mean_rounded(run_experiment(raw, plan)["metrics"], *METRICS)


# models whose numbers depend on the learner: rows only


def _split_fill(spark, sf):
    return prep.split(ev_stored(spark, sf), VAL, START)


def _tree_metrics(fit):
    def query(spark, sf):
        d = _split_fill(spark, sf)
        known = d.filter("split <> 'test'").drop("split")
        model = fit(known, "1h", 24, 6)
        all_rows = d.drop("split")
        fc = trees.backtest_rows(model, all_rows, "1h", backtest.origins(all_rows, "1h", START, 6))
        return mean_rounded(backtest.evaluate(all_rows, fc, "1h", START, 6), *METRICS)

    return query


register("m_04_random_forest")(_tree_metrics(lambda d, *a: trees.fit_forest(d, *a, trees=10, depth=5)))
register("m_05_boosted_trees")(_tree_metrics(lambda d, *a: trees.fit_gbt(d, *a, rounds=5, depth=3)))


@register("m_06_differenced_ar")
def m_06(spark, sf):
    d = stored(od_fill(spark, sf), "od_fill")
    model = ar.fit_ar(d, "1d", 12, 1)
    return rounded(ar.forecast_ar(d, model, "1d", 12, 1, 14), "yhat")


AR_ONE = """WITH RECURSIVE z AS (SELECT *, value - lag(value) OVER (PARTITION BY ts_id, id ORDER BY ts) AS z0 FROM od_fill),
    fit AS (SELECT ts_id, id, regr_slope(z0, z1) AS b, regr_intercept(z0, z1) AS a FROM (
        SELECT *, lag(z0) OVER (PARTITION BY ts_id, id ORDER BY ts) AS z1 FROM z) WHERE z0 IS NOT NULL AND z1 IS NOT NULL GROUP BY 1, 2),
    last AS (SELECT ts_id, id, max(ts) AS t0, arg_max(value, ts) AS v, arg_max(z0, ts) AS d FROM z GROUP BY 1, 2),
    path AS (SELECT ts_id, id, t0, a, b, 1 AS step, a + b * d AS d, v + a + b * d AS v FROM last JOIN fit USING (ts_id, id)
        UNION ALL SELECT ts_id, id, t0, a, b, step + 1, a + b * d, v + a + b * d FROM path WHERE step < 14)
    SELECT ts_id, id, t0 + INTERVAL 1 DAY AS origin, step, t0 + to_days(step) AS ts, round(v, 2) AS yhat, NULL::VARCHAR AS reason FROM path"""


@register("m_06_ar_one_lag", "od_fill", sql=AR_ONE)
def m_06_one(spark, sf):
    d = stored(od_fill(spark, sf), "od_fill")
    return rounded(ar.forecast_ar(d, ar.fit_ar(d, "1d", 1, 1), "1d", 1, 1, 14), "yhat", digits=2)


AR_BACK = """WITH RECURSIVE z AS (SELECT *, value - lag(value) OVER (PARTITION BY ts_id, id ORDER BY ts) AS z0 FROM od_fill),
    fit AS (SELECT ts_id, id, regr_slope(z0, z1) AS b, regr_intercept(z0, z1) AS a FROM (
        SELECT *, lag(z0) OVER (PARTITION BY ts_id, id ORDER BY ts) AS z1 FROM z) WHERE z0 IS NOT NULL AND z1 IS NOT NULL GROUP BY 1, 2),
    origins AS (SELECT ts_id, id, unnest(generate_series(TIMESTAMP '1999-01-01', max(ts) - INTERVAL 13 DAY, INTERVAL 14 DAY)) AS origin FROM od_fill GROUP BY 1, 2),
    path AS (SELECT ts_id, id, origin, a, b, 1 AS step, a + b * z0 AS d, value + a + b * z0 AS v FROM origins JOIN fit USING (ts_id, id)
            JOIN z USING (ts_id, id) WHERE ts = origin - INTERVAL 1 DAY
        UNION ALL SELECT ts_id, id, origin, a, b, step + 1, a + b * d, v + a + b * d FROM path WHERE step < 14)
    SELECT ts_id, id, origin, step, origin + to_days(step - 1) AS ts, round(v, 2) AS yhat, NULL::VARCHAR AS reason FROM path"""


@register("m_06_ar_backtest", "od_fill", sql=AR_BACK)
def m_06_back(spark, sf):
    d = stored(od_fill(spark, sf), "od_fill")
    origin = backtest.origins(d, "1d", "19990101", 14)
    return rounded(ar.forecast_ar(d, ar.fit_ar(d, "1d", 1, 1), "1d", 1, 1, 14, origin), "yhat", digits=2)


@register("m_07_predict_recursive")
def m_07(spark, sf):
    known = _split_fill(spark, sf).filter("split <> 'test'").drop("split")
    model = trees.fit_forest(known, "1h", 24, 6, trees=5, depth=4)
    return rounded(trees.predict_recursive(model, known, "1h", 24), "yhat")


@register("m_09_forecast")
def m_09(spark, sf):
    d = _split_fill(spark, sf)
    scaler = prep.fit_minmax(d)
    known = d.filter("split <> 'test'").drop("split")
    model = trees.fit_forest(prep.scale(known, scaler), "1h", 24, 12, trees=5, depth=4)
    return rounded(trees.forecast(known, model, scaler, "1h", 24), "yhat")


@register("m_10_quantiles")
def m_10(spark, sf):
    d = ev_stored(spark, sf)
    known = prep.split(d, VAL, START).filter("split = 'train'").drop("split")
    fitted = backtest.merge_windows(naive.seasonal_naive(known, "1h", 1, "20240103", H), H)
    e = fitted.join(known, ["ts_id", "id", "ts"]).select("ts_id", "id", "ts", (F.col("value") - F.col("yhat")).alias("e"))
    samples = paths.sample_paths(fc_day(d), e, "1h", 50, seed=7)
    return rounded(paths.quantiles(samples, [0.1, 0.5, 0.9]), "q_10", "q_50", "q_90")


SIX = f"""SELECT ts_id, id, date_trunc('day', ts) + to_hours((hour(ts) // 6 * 6)::INTEGER) AS ts, avg(x) AS value FROM flag_line GROUP BY 1, 2, 3"""
part(
    "flag_ok",
    """SELECT ts_id, id, ts, value FROM (SELECT *, avg(value) OVER m AS mean, stddev_samp(value) OVER m AS sd FROM ev_hour
        WINDOW m AS (PARTITION BY ts_id, id, month(ts))) WHERE NOT coalesce(abs(value - mean) > 4.5::DOUBLE * sd, false)""",
    "ev_hour",
)
part(
    "flag_grid",
    """SELECT g.ts_id, g.id, g.ts, s.value FROM (SELECT ts_id, id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
        FROM flag_ok GROUP BY 1, 2) g LEFT JOIN flag_ok s USING (ts_id, id, ts)""",
    "flag_ok",
)
part(
    "flag_line",
    """SELECT ts_id, id, ts, CASE WHEN value IS NOT NULL THEN value WHEN nt IS NULL THEN pv
        ELSE pv + (nv - pv) * date_diff('second', pt, ts)::DOUBLE / date_diff('second', pt, nt)::DOUBLE END AS x FROM (
        SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS pt,
            first_value(value IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS nt FROM flag_grid
        WINDOW b AS (PARTITION BY ts_id, id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               f AS (PARTITION BY ts_id, id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "flag_grid",
)
part("flag_six", SIX, "flag_line")
part(
    "flag_fc",
    f"""SELECT 1 AS days, f.ts_id, f.id, f.origin, f.step, f.ts, s.value AS yhat FROM (
        SELECT ts_id, id, origin, step, origin + to_hours(((step - 1) * 6)::INTEGER) AS ts FROM (
            SELECT ts_id, id, origin, unnest(range(1, 5)) AS step FROM (
                SELECT ts_id, id, unnest(generate_series(min(ts) FILTER (ts >= {START_SQL}), max(ts) - INTERVAL 18 HOUR, INTERVAL 24 HOUR)) AS origin
                FROM flag_six GROUP BY 1, 2))) f
        LEFT JOIN flag_six s ON s.ts_id = f.ts_id AND s.id = f.id AND s.ts = f.ts - INTERVAL 24 HOUR""",
    "flag_six",
)
part("flag_cm", _components("flag_six", "flag_fc", START_SQL, 4, 4), "flag_fc")
part("flag_sm", _series("flag_cm"), "flag_cm")
register("flagship", "flag_sm", sql=f"SELECT ts_id, {', '.join(f'round({c}, 4) AS {c}' for c in METRICS)} FROM flag_sm")(flagship)
