"""Queries for trials, run tables and feature attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.quantile import exact_median
from tidewell.models import trees
from tidewell.operators import prep
from tidewell.plans import backtest, explain, results
from tidewell.plans.backtest import METRICS

from .base import ev_fill, ev_grid, ev_multi, ev_stored, mean_r, mean_rounded, mean_sql, multi_fill, multi_stored, part, register, rounded
from .forecasting import START, VAL, _shown, fc_day

DAYS = {"days": ["list", 1, 2, 7]}
SPACE = {"days": ["list", 1, 2, 7], "lags": ["range", 6, 24, 6], "span": ["equal", "lags"], "scaled": True}


@register(
    "r_01_expand_grid",
    "ev_multi",
    sql="""SELECT ts_id, ((d.i * 4) + l.i)::BIGINT AS trial_id, d.v::VARCHAR AS days, l.v::VARCHAR AS lags, l.v::VARCHAR AS span, 'True' AS scaled, n
        FROM (SELECT ts_id, count(*) AS n FROM ev_multi GROUP BY 1), (VALUES (0, 1), (1, 2), (2, 7)) d(i, v), (VALUES (0, 6), (1, 12), (2, 18), (3, 24)) l(i, v)""",
)
def r_01(spark, sf):
    # every series gets every trial; the grid travels as a literal array, whose size is that of the space
    rows = results.expand_space(SPACE)
    grid = F.array(*[F.struct(F.lit(i).cast("bigint").alias("trial_id"), *[F.lit(str(v)).alias(k) for k, v in row.items()]) for i, row in enumerate(rows)])
    sizes = ev_multi(spark, sf).groupBy("ts_id").agg(F.count("*").alias("n"))
    return sizes.withColumn("t", F.explode(grid)).select("ts_id", "t.*", "n")


def _known(spark, sf):
    return prep.split(ev_stored(spark, sf), VAL, START).filter("split <> 'test'").drop("split")


def _scored(spark, sf, days=(1, 2, 7)):
    return results.score_naive_trials(_known(spark, sf), "1h", list(days), VAL, 24)


@register(
    "r_02_sample_trials",
    "sm_val",
    sql=f"""SELECT days, ts_id, {_shown(*METRICS)} FROM sm_val WHERE days IN (
        SELECT v FROM (VALUES (0, 1), (1, 2), (2, 7)) d(i, v) ORDER BY md5('3:' || i::VARCHAR), i LIMIT 2)""",
)
def r_02(spark, sf):
    trials = results.sample_trials(results.expand_grid(spark, DAYS), 2, seed=3)
    days = sorted(int(t["params"]["days"]) for t in trials.collect())
    return mean_rounded(_scored(spark, sf, days), *METRICS)


@register("r_03_score_trials", "sm_val", sql=f"SELECT days, ts_id, {_shown(*METRICS)} FROM sm_val")
def r_03(spark, sf):
    return mean_rounded(_scored(spark, sf), *METRICS)


@register("r_03_score_tree_trials")
def r_03b(spark, sf):
    known = _known(spark, sf)
    train = prep.split(known, VAL, START).filter("split = 'train'").drop("split")

    def score(p):
        model = trees.fit_forest(train, "1h", p["lags"], 6, trees=5, depth=p["depth"])
        fc = trees.backtest_rows(model, known, "1h", backtest.origins(known, "1h", VAL, 6))
        return backtest.evaluate(known, fc, "1h", VAL, 6)

    scored = results.score_trials(results.expand_space({"lags": ["list", 6, 24], "depth": 4}), score)
    return mean_rounded(scored.withColumn("params", F.to_json("params")), *METRICS)


LEDGER = "SELECT days, count(*) AS n_series, " + ", ".join(f"avg({c}) AS {c}" for c in METRICS) + " FROM sm_val GROUP BY 1"
part("ledger", LEDGER, "sm_val")


@register("r_04_best_trial", "ledger", sql=f"SELECT days, n_series, {_shown(*METRICS)} FROM ledger ORDER BY mae NULLS LAST, days LIMIT 1")
def r_04(spark, sf):
    return mean_rounded(results.best_trial(results.trials_table(_scored(spark, sf)), "mae", "days"), *METRICS)


@register("r_05_trials_table", "ledger", sql=f"SELECT days, n_series, {_shown(*METRICS)} FROM ledger")
def r_05(spark, sf):
    return mean_rounded(results.trials_table(_scored(spark, sf)), *METRICS)


RUNS = " UNION ALL ".join(f"SELECT ts_id AS experiment, days::VARCHAR AS run_id, '{m}' AS metric, {m} AS value FROM sm_val" for m in METRICS)
part("runs", RUNS, "sm_val")


def _runs(spark, sf):
    return results.runs_table(_scored(spark, sf), "days", "ts_id")


@register(
    "r_06_best_run",
    "runs",
    sql=f"""SELECT experiment, run_id, metric, {mean_sql('value')} AS value FROM runs WHERE experiment = 'click' AND metric = 'rmse' AND value IS NOT NULL
        ORDER BY runs.value, run_id LIMIT 1""",
)
def r_06(spark, sf):
    return mean_rounded(results.best_run(_runs(spark, sf), "click", "rmse"))


@register(
    "r_07_metric_list",
    "runs",
    sql=f"""SELECT experiment, run_id, string_agg(metric, ',' ORDER BY metric) AS labels, count(value) AS n, {mean_sql('sum(value)')} AS total
        FROM runs GROUP BY 1, 2""",
)
def r_07(spark, sf):
    d = results.metric_list(_runs(spark, sf))
    total = F.aggregate("vals", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    known = F.size(F.filter("vals", lambda v: v.isNotNull())).cast("bigint")
    return d.select("experiment", "run_id", F.array_join("labels", ",").alias("labels"), known.alias("n"), mean_r(total).alias("total"))


@register(
    "r_08_forecast_vs_actual",
    "fc_multi",
    sql=f"""SELECT * FROM (SELECT 'forecast' AS kind, ts_id, id, ts, {mean_sql('yhat')} AS value FROM fc_multi ORDER BY ts DESC, ts_id, id LIMIT 24)
        UNION ALL SELECT * FROM (SELECT 'actual', ts_id, id, ts, {mean_sql('value')} FROM multi_fill ORDER BY ts DESC, ts_id, id LIMIT 24)""",
)
def r_08(spark, sf):
    d = multi_stored(spark, sf)
    return mean_rounded(results.forecast_vs_actual(fc_day(d), d, 24))


def _wsql(length: int) -> str:
    steps = ", ".join(f"{mean_sql(f'lead(value, {i}) OVER w')} AS step_{i}" if i else f"{mean_sql('value')} AS step_0" for i in range(length))
    return f"""SELECT ts_id, id, ts, epoch(ts)::BIGINT AS epoch, {steps} FROM multi_fill WHERE ts >= TIMESTAMP '2024-01-22'
        WINDOW w AS (PARTITION BY ts_id, id ORDER BY ts) QUALIFY lead(ts, {length - 1}) OVER w IS NOT NULL"""


def _test(d):
    return prep.split(d, VAL, START).filter("split = 'test'").drop("split")


@register("x_01_window_dataset", "multi_fill", sql=_wsql(6))
def x_01(spark, sf):
    d = explain.step_columns(explain.window_dataset(_test(multi_fill(spark, sf)), "1h", 6, 3), 6)
    return mean_rounded(d, *[f"step_{i}" for i in range(6)])


def _sample_sql(wanted: str) -> str:
    return f"""SELECT ts_id, id, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY key, id, ts) AS rank FROM (
            SELECT ts_id, id, ts, ('0x' || substr(md5(concat_ws('|', '3', ts_id, id, epoch(ts)::BIGINT::VARCHAR)), 1, 12))::BIGINT AS key FROM (
                SELECT *, count(*) OVER (PARTITION BY ts_id, id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n FROM multi_fill
                WHERE ts >= TIMESTAMP '2024-01-22') WHERE n = 6)) WHERE {wanted}"""


@register("x_01_sample_number", "multi_fill", sql=_sample_sql("rank <= 40"))
def x_01_number(spark, sf):
    return explain.window_dataset(_test(multi_stored(spark, sf)), "1h", 6, 3, size=40, seed=3).select("ts_id", "id", "ts")


@register("x_01_sample_share", "multi_fill", sql=_sample_sql(f"key < {round(0.2 * 16**12)}"))
def x_01_share(spark, sf):
    return explain.window_dataset(_test(multi_stored(spark, sf)), "1h", 6, 3, size=0.2, seed=3).select("ts_id", "id", "ts")


@register(
    "x_01_window_covariates",
    "ev_fill",
    "multi_fill",
    sql=f"""WITH c AS (SELECT ts_id, id, ts, list(value) OVER (PARTITION BY ts_id, id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS p,
            list(value) OVER (PARTITION BY ts_id, id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS f FROM multi_fill),
        t AS (SELECT *, list(value) OVER (PARTITION BY ts_id, id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s FROM ev_fill
            WHERE ts >= TIMESTAMP '2024-01-22')
        SELECT t.ts_id, t.id, t.ts, epoch(t.ts)::BIGINT AS epoch, {mean_sql('list_sum(s)')} AS steps, {mean_sql('a.p')} AS past, {mean_sql('a.f')} AS future
        FROM t JOIN (SELECT ts_id, ts, sum(list_sum(p)) FILTER (len(p) = 9) AS p, count(*) FILTER (len(p) = 9) AS np,
                sum(list_sum(f)) FILTER (len(f) = 12) AS f, count(*) FILTER (len(f) = 12) AS nf FROM c GROUP BY 1, 2) a
            ON a.ts_id = t.ts_id AND a.ts = t.ts AND np > 0 AND nf > 0 WHERE len(s) = 6""",
)
def x_01b(spark, sf):
    c = multi_stored(spark, sf)
    d = explain.window_dataset(_test(ev_fill(spark, sf)), "1h", 6, 3, c, c)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    every = lambda m: total(F.transform(F.map_values(m), total))
    out = d.select("ts_id", "id", "ts", "epoch", total("steps").alias("steps"), every("past").alias("past"), every("future").alias("future"))
    return mean_rounded(out, "steps", "past", "future")


@register(
    "x_02_background",
    "multi_fill",
    "ev_grid",
    sql=f"""SELECT 'target' AS kind, id, {mean_sql('median(m)')} AS value FROM (
            SELECT ts_id, id, median(value) AS m FROM multi_fill WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2) GROUP BY 2
        UNION ALL SELECT 'covariate', id, {mean_sql('median(value)')} FROM ev_grid GROUP BY 2""",
)
def x_02(spark, sf):
    train = prep.split(multi_fill(spark, sf), VAL, START).filter("split = 'train'").drop("split")
    return mean_rounded(explain.background(train, ev_grid(spark, sf)))


def _attributions(spark, sf, size):
    """Shapley values of a forest on windows of the test set."""
    d = ev_stored(spark, sf)
    train = prep.split(d, VAL, START).filter("split = 'train'").drop("split")
    model = trees.fit_forest(train, "1h", 6, 1, trees=5, depth=4)
    windows = explain.window_dataset(_test(d), "1h", 6, 1, size=size, seed=1)
    lags = {f"lag_{k}": F.col("steps")[6 - k] for k in range(1, 7)}
    rows = windows.select(F.concat_ws("|", "ts_id", "ts").alias("row_key"), *[c.alias(n) for n, c in lags.items()], F.lit(1.0).alias("step"))
    middle = exact_median(exact_median(train, ["ts_id", "id"], "value", "m").withColumn("all", F.lit(1)), ["all"], "m", "v").first()["v"]
    base = {**{n: middle for n in lags}, "step": 1.0}
    return explain.attribute(model, rows, model.inputs, base, perms=4, seed=1)


@register("x_03_attribute")
def x_03(spark, sf):
    return rounded(_attributions(spark, sf, None), "attribution")


@register("x_04_top_features")
def x_04(spark, sf):
    return rounded(explain.top_features(_attributions(spark, sf, None), 20), "importance")


@register(
    "x_04_top_forecast_errors",
    "fc_day",
    sql=f"""SELECT feature, {mean_sql('avg(abs(attribution))')} AS importance FROM (
        SELECT f.ts_id || ' ' || f.step::VARCHAR AS feature, a.value - f.yhat AS attribution FROM fc_day f
        JOIN ev_fill a ON a.ts_id = f.ts_id AND a.id = f.id AND a.ts = f.ts) GROUP BY 1 ORDER BY avg(abs(attribution)) DESC, feature LIMIT 20""",
)
def x_04b(spark, sf):
    d = ev_stored(spark, sf)
    e = fc_day(d).join(d, ["ts_id", "id", "ts"])
    named = e.select(F.concat_ws(" ", "ts_id", F.col("step").cast("string")).alias("feature"), (F.col("value") - F.col("yhat")).alias("attribution"))
    return mean_rounded(explain.top_features(named, 20), "importance")

