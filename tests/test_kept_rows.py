"""No row vanishes without a word, and answers hold outside the usual inputs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import HOUR, at, frame, values
from tidewell.functions.quantile import exact_quantile
from tidewell.models import ar, naive, paths, trees
from tidewell.operators import clean, covariates, prep, profile
from tidewell.durable import scratch, stored
from tidewell.plans import backtest, results
from tidewell.plans.experiment import Experiment, run_experiment
from tidewell.plans.preparation import Preparation, prepare
from tidewell.sources import layouts


def test_forecasts_keep_every_component(spark):
    vs = [float(i % 24) + random.Random(i).random() for i in range(200)]
    d = frame(spark, {("a", "x"): vs, ("short", "x"): vs[:3], ("ends", "x"): [*vs, None]})
    tree = trees.predict_recursive(trees.fit_forest(d, "1h", 4, 2, trees=2, depth=3), d, "1h", 3).collect()
    lags = ar.forecast_ar(d, ar.fit_ar(d, "1h", 4, 1), "1h", 4, 1, 3).collect()
    for got in (tree, lags):
        reasons = {r["ts_id"]: r["reason"] for r in got}
        assert reasons == {"a": None, "short": "short", "ends": "missing"} and len(got) == 9
        assert all((r["yhat"] is None) == (r["ts_id"] != "a") for r in got)


def test_tree_backtest_keeps_origins_with_gaps(spark):
    vs = [float(i % 12) for i in range(120)]
    vs[100] = None
    d = frame(spark, {("a", "x"): vs})
    model = trees.fit_forest(d, "1h", 3, 1, trees=2, depth=3)
    at_ = backtest.origins(d, "1h", at(90).isoformat(sep=" "), 1)
    got = trees.backtest_rows(model, d, "1h", at_)
    assert got.count() == at_.count()
    assert [r["ts"] for r in got.filter("yhat is null").orderBy("ts").collect()] == [at(i) for i in (101, 102, 103)]
    m = backtest.component_metrics(d, got, "1h", at(90).isoformat(sep=" "), 1).first()
    assert m["n_missing"] == 3 and m["mae"] is None


def test_scaling_keeps_components_without_a_scaler(spark):
    d = frame(spark, {("a", "x"): [1.0, 3.0], ("b", "x"): [5.0]})
    scaler = prep.fit_minmax(d.filter("ts_id = 'a'"))
    scaled = prep.scale(d, scaler)
    assert values(scaled) == {("a", "x"): [0.0, 1.0], ("b", "x"): [None]}
    assert values(prep.unscale(scaled, scaler)) == {("a", "x"): [1.0, 3.0], ("b", "x"): [None]}


def test_paths_keep_components_without_residuals(spark):
    d = frame(spark, {("a", "x"): [1.0] * 4, ("b", "x"): [2.0] * 4})
    fc = d.select("ts_id", "id", F.col("ts").alias("origin"), F.lit(1).alias("step"), "ts", F.col("value").alias("yhat"))
    e = d.filter("ts_id = 'a'").select("ts_id", "id", "ts", F.col("value").alias("e"))
    got = paths.sample_paths(fc, e, "1h", 3).collect()
    assert len(got) == 24 and {r["yhat"] for r in got if r["ts_id"] == "b"} == {None}


def test_lists_name_everything(spark):
    d = frame(spark, {("a", "x"): [1.0], ("a", "y"): [2.0]})
    for wrong in (
        lambda: prep.stack(d, ["x"]),
        lambda: covariates.attach_covariates(d, d, ["x"]),
        lambda: layouts.long_to_short(d, ["00:00:00"]),
    ):
        with pytest.raises(Exception, match="not listed"):
            wrong().collect()


@pytest.mark.parametrize("n", [1, 2, 50, 30_000])
def test_quantile_has_one_path(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(size=n), 2)
    d = spark.createDataFrame([("k", float(x)) for x in v], "k string, v double")
    for q in (0.0, 0.01, 0.5, 0.99, 1.0):
        assert abs(exact_quantile(d, ["k"], "v", q, "out").first()["out"] - np.quantile(v, q)) < 1e-9


def test_preparation_takes_the_first_duplicate(spark):
    rows = [("a", "x", at(0), 10.0, 1), ("a", "x", at(0), 20.0, 0), ("a", "x", at(1), 5.0, 2)]
    schema = "ts_id string, id string, ts timestamp_ntz, value double, row_id long"
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, schema)
        zones = spark.createDataFrame([("x", "Europe/Berlin")], "country string, tz string")
        for zone in (None, zones):
            out = prepare(d, Preparation("1h", std_dev=None), zone).orderBy("ts").collect()
            assert [r["value"] for r in out] == [20.0, 5.0]
    with pytest.raises(ValueError):
        prepare(d.drop("row_id"), Preparation("1h"))


def test_one_zone_for_a_country(spark):
    d = frame(spark, {("a", "x"): [1.0]})
    zones = spark.createDataFrame([("x", "Europe/Berlin"), ("x", "Europe/Athens")], "country string, tz string")
    with pytest.raises(Exception, match="several time zones"):
        clean.to_local(d, zones).collect()


def test_naive_period_is_whole_steps_of_a_day(spark):
    d = frame(spark, {("a", "x"): [float(i) for i in range(60)]}, 7 * HOUR)
    start = at(40, 7 * HOUR).isoformat(sep=" ")
    one = naive.seasonal_naive(d, "7h", 7, start, 3).orderBy("origin", "step").collect()
    many = naive.seasonal_naive(d, "7h", [7], start, 3).orderBy("origin", "step").collect()
    assert [r["yhat"] for r in one] == [r["yhat"] for r in many]
    assert one[0]["yhat"] == 40 - 7 * 3
    with pytest.raises(ValueError):
        naive.seasonal_naive(d, "2d", [7], start, 3)


def test_combine_meets_components_by_name(spark):
    a = frame(spark, {("s", "x"): [1.0, 2.0], ("s", "y"): [3.0, 4.0]})
    b = frame(spark, {("s", "x"): [10.0, 20.0], ("s", "y"): [100.0, 200.0]})
    assert values(covariates.combine(a, b)) == {("s", "x"): [11.0, 22.0], ("s", "y"): [103.0, 204.0]}
    one = frame(spark, {("s", "z"): [10.0, 20.0]})
    assert values(covariates.combine(a, one, "-")) == {("s", "x"): [-9.0, -18.0], ("s", "y"): [-7.0, -16.0]}


@pytest.mark.parametrize("level", [0.0, 1e3, 1e7])
def test_autoregression_on_high_levels(spark, level):
    rnd, z = random.Random(3), [0.0]
    for _ in range(2000):
        z.append(0.8 * z[-1] + rnd.gauss(0, 1))
    d = frame(spark, {("a", "x"): [level + x for x in z]})
    const, lag = ar.fit_ar(d, "1h", 1, 0).first()["coef"]
    assert abs(lag - 0.8) < 0.05 and abs(const - level * (1 - lag)) < 0.2 + level * 1e-9


def test_split_dates(spark):
    rows = [("a", "x", dt.datetime(2024, 1, d), float(d)) for d in range(1, 31)]
    d = spark.createDataFrame(rows, "ts_id string, id string, ts timestamp_ntz, value double")
    count = lambda *a: sorted(map(tuple, prep.split(d, *a).groupBy("split").count().collect()))
    assert count("20240120", "2024-01-20") == count("20240120", "20240120")
    for wrong in (("20240120", "20240110"), ("20240230", "20240301"), ("20240110", "20240120", "20240115")):
        with pytest.raises(ValueError):
            prep.split(d, *wrong)


def test_resolution_of_stamps_below_a_second(spark):
    rows = [("a", "x", dt.datetime(2024, 1, 1, 0, 0, i // 4, i % 4 * 250_000), 1.0) for i in range(40)]
    d = spark.createDataFrame(rows, "ts_id string, id string, ts timestamp_ntz, value double")
    assert profile.infer_resolution(d).first()["resolution"] == "1s"


def test_recursion_from_many_origins(spark):
    """The same as cutting the data before each origin and forecasting from its end."""
    vs = [float(i % 12) + random.Random(i).random() for i in range(150)]
    d = frame(spark, {("a", "x"): vs, ("b", "x"): vs[::-1]})
    start = at(100).isoformat(sep=" ")
    origin = backtest.origins(d, "1h", start, 7, 7)
    tree, lags = trees.fit_forest(d, "1h", 5, 3, trees=2, depth=3), ar.fit_ar(d, "1h", 3, 1)
    for many, one in (
        (trees.predict_recursive(tree, d, "1h", 7, origin), lambda x: trees.predict_recursive(tree, x, "1h", 7)),
        (ar.forecast_ar(d, lags, "1h", 3, 1, 7, origin), lambda x: ar.forecast_ar(x, lags, "1h", 3, 1, 7)),
    ):
        rows = many.collect()
        assert len(rows) == 2 * 7 * 7
        got = {(r["ts_id"], r["ts"]): r["yhat"] for r in rows if r["origin"] == at(107)}
        want = {(r["ts_id"], r["ts"]): r["yhat"] for r in one(d.filter(F.col("ts") < at(107))).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    fc = backtest.evaluate(d, many, "1h", start, 7).collect()
    assert len(fc) == 2 and all(r["mae"] is not None for r in fc)


def test_covariates_in_trees(spark):
    """A target that follows its covariate is forecast well with it, also beyond the end of the series."""
    rnd = random.Random(2)
    c = [rnd.choice([0.0, 10.0]) for _ in range(420)]
    d = frame(spark, {("a", "x"): c[:400]})
    wide = frame(spark, {("a", "c"): c}).select("ts_id", "ts", F.col("value").alias("c"))
    rows = d.join(wide, ["ts_id", "ts"])
    model = trees.fit_forest(rows, "1h", 3, 2, trees=8, depth=5, past={"c": 1}, future={"c": (0, 2)})
    got = trees.predict_recursive(model, d, "1h", 8, covs=wide).orderBy("step").collect()
    # the second chunk lacks the past covariate only where the table ends
    assert [r["step"] for r in got] == list(range(1, 9)) and all(abs(r["yhat"] - c[399 + r["step"]]) < 3 for r in got)
    short = trees.predict_recursive(model, d, "1h", 8, covs=wide.filter(F.col("ts") < at(404))).orderBy("step").collect()
    assert [r["reason"] for r in short] == [None] * 4 + ["covariates"] * 4
    back = trees.backtest_rows(model, rows, "1h", backtest.origins(rows, "1h", at(300).isoformat(sep=" "), 2))
    error = back.join(d, ["ts_id", "id", "ts"]).agg(F.avg(F.abs(F.col("yhat") - F.col("value")))).first()[0]
    assert error < 2
    with pytest.raises(ValueError):
        trees.predict_recursive(model, d, "1h", 8)


@pytest.mark.parametrize("model", ["naive", "ar", "forest"])
def test_experiment(spark, model):
    vs = [10.0 + (i % 12) + 0.1 * random.Random(i).random() for i in range(400)]
    raw = frame(spark, {("a", "x"): vs, ("a", "y"): vs[3:], ("b", "x"): [v * 5 for v in vs]}).withColumn("row_id", F.lit(0))
    options = {"naive": {"days": 1}, "ar": {"p": 12, "d": 0}, "forest": {"lags": 12, "output": 4, "future": {"c": (0, 1)}}}
    covs = frame(spark, {("a", "c"): vs, ("b", "c"): vs}).select("ts_id", "ts", F.col("value").alias("c"))
    e = Experiment(Preparation("1h", min_island=2), "20230408", "20230411", model=model, options=options[model], horizon=24)
    out = run_experiment(raw, e, covs=covs if model == "forest" else None)
    assert set(out) == {
        "series", "forecasts", "metrics", "outliers", "short_islands", "imputed", "residual_ranges", "violations", "actuals", "scaler", "scaled_forecasts"
    }
    assert {r["ts_id"] for r in out["metrics"].collect()} == {"a", "b"}
    assert all(r["mape"] < 12 for r in out["metrics"].collect())
    starts = out["series"].filter("ts_id = 'a'").groupBy("id").agg(F.min("ts").alias("lo")).select("lo").distinct()
    assert starts.count() == 1  # one span for all components


def test_experiment_guards():
    with pytest.raises(ValueError):
        Experiment(Preparation("1h", to="30min"), "20240101", "20240102")
    with pytest.raises(ValueError):
        Experiment(Preparation("1h"), "20240101", "20240102", model="other")


def test_trials_together(spark):
    got = results.score_trials([{"k": i} for i in range(5)], lambda p: spark.range(2).select(F.lit(p["k"] * 2).alias("mae")))
    assert sorted((r["trial_id"], r["params"]["k"], r["mae"]) for r in got.collect()) == sorted((i, str(i), 2 * i) for i in range(5) for _ in range(2))


def test_scratch_tables_go(spark):
    with scratch(spark):
        d = stored(spark.range(3))
        assert d.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        d.count()
