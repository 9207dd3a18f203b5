"""Forecasters, backtests, trials and attribution."""

import math
import random
import statistics

import numpy as np
import pytest
from helpers import HOUR, at, close, frame, masked, same, values
from pyspark.sql import functions as F

from catalog.features import QUADRATIC_7
from tidewell.functions.quantile import exact_quantile
from tidewell.models import ar, features, naive, paths, trees
from tidewell.operators import covariates, prep
from tidewell.plans import backtest, explain, results
from tidewell.plans.preparation import Preparation, prepare


def seasonal(n: int, seed: int = 0, noise: float = 1.0) -> list:
    rnd = random.Random(seed)
    return [50 + 20 * math.sin(2 * math.pi * i / 24) + rnd.gauss(0, noise) for i in range(n)]


@pytest.mark.parametrize("q", [0.0, 0.01, 0.37, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rnd = random.Random(1)
    groups = {"small": [rnd.random() for _ in range(7)], "one": [3.0], "large": [rnd.gauss(0, 1) for _ in range(60000)]}
    groups["ties"] = [float(rnd.randint(0, 5)) for _ in range(45000)]
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["q"] for r in exact_quantile(d, ["k"], "v", q, "q").collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert close(got[k], float(np.quantile(vs, q)), 1e-12), k


def test_savgol_reproduces_polynomials(spark):
    vs = [2.0 - 3 * i + 0.5 * i * i for i in range(40)]
    got = values(prep.savgol(frame(spark, {("a", "x"): vs}), "1h", 7, 2, 10 * HOUR))[("a", "x")]
    assert all(close(a, b, 1e-7) for a, b in zip(got, vs))


def test_savgol_weights_are_exact():
    """The nearest doubles of the fractions, so that sums halfway between two rounded values match the SQL."""
    assert (prep.savgol_table(7, 2) == np.array(QUADRATIC_7)).all()
    assert (prep.savgol_table(5, 4) == np.eye(5)).all()


@pytest.mark.parametrize("span", [6 * HOUR, None])
def test_fragments(spark, span):
    a, b = masked(60, 1), masked(60, 2)
    want, last, no = {}, None, -1
    for i in range(60):
        if a[i] is not None and b[i] is not None:
            no += last != i - 1
            want[at(i)] = no
            last = i
    got = prep.split_fragments(frame(spark, {("s", "a"): a, ("s", "b"): b}), "1h", span).collect()
    assert {r["ts"]: r["fragment_id"] for r in got} == want
    assert len(got) == 2 * len(want)


def test_split_and_scale(spark):
    d = frame(spark, {("a", "x"): [float(i) for i in range(100)], ("b", "x"): [7.0] * 100})
    s = prep.split(d, "20230401", "20230402", "20230402")
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 2 * 43, "val": 2 * 24, "test": 2 * 24}
    twice = prep.split(d, "20230401", "20230401")
    assert {r["split"]: r["count"] for r in twice.groupBy("split").count().collect()} == {"train": 86, "val": 114, "test": 114}
    scaler = prep.fit_minmax(s)
    scaled = values(prep.scale(d, scaler))
    assert close(scaled[("a", "x")][21], 0.5) and scaled[("b", "x")][0] == 0.0
    same(values(prep.unscale(prep.scale(d, scaler), scaler)), values(d))


def test_shift_ranges(spark):
    vs = [float(i) for i in range(100)]
    d = frame(spark, {("a", "x"): vs})
    got = values(covariates.shift_ranges(d, "1h", [("2023-03-31", "2023-03-31", 3), (None, None, -2)]))[("a", "x")]
    first = [None if 19 <= i < 22 else vs[i - 3] if 22 <= i < 43 else vs[i] for i in range(100)]
    assert got == first[2:] + [None, None]


def test_stitch_and_broadcast(spark):
    base = frame(spark, {("a", "x"): [1.0] * 5})
    newer = frame(spark, {("a", "x"): [2.0] * 8, ("b", "x"): [3.0] * 2})
    assert values(covariates.stitch(base, newer)) == {("a", "x"): [1.0] * 5 + [2.0] * 3, ("b", "x"): [3.0] * 2}
    shared = covariates.broadcast_covariates(frame(spark, {("c", "sun"): [1.0, 2.0]}), newer)
    assert values(shared) == {("a", "sun_a"): [1.0, 2.0], ("b", "sun_b"): [1.0, 2.0]}


def test_lag_features_cross_slices(spark):
    vs = masked(80, 3, 0.1)
    d = features.lag_features(frame(spark, {("a", "x"): vs}), "1h", [1, 5], horizon=3, span=8 * HOUR)
    for column, k in (("lag_1", -1), ("lag_5", -5), ("y_0", 0), ("y_2", 2)):
        assert values(d, column=column)[("a", "x")] == [vs[i + k] if 0 <= i + k < 80 else None for i in range(80)]


def test_feature_names():
    assert features.lag_list(3) == [1, 2, 3] and features.lag_list([-24, -1]) == [1, 24]
    assert features.future_offsets((2, 2)) == [-2, -1, 0, 1]
    assert features.feature_columns(1, {"p": 1}, {"f": (1, 1)}) == ["lag_1", "p_lag_1", "f_lag_1", "f_lead_0"]


@pytest.mark.parametrize("horizon,stride", [(24, 24), (24, 6), (30, 7), (50, 50)])
def test_naive_and_windows(spark, horizon, stride):
    vs = seasonal(200)
    d = frame(spark, {("a", "x"): vs})
    start = at(80).isoformat(sep=" ")
    fc = naive.seasonal_naive(d, "1h", 1, start, horizon, stride)
    want = {
        (o, h): vs[o + h - 24 * -(-(h + 1) // 24)] for o in range(80, 200 - horizon + 1, stride) for h in range(horizon)
    }
    hours = lambda t: int((t - at(0)).total_seconds()) // HOUR
    got = {(hours(r["origin"]), r["step"] - 1): r["yhat"] for r in fc.collect()}
    assert got == want
    merged = [hours(r["ts"]) for r in backtest.merge_windows(fc, horizon, stride).collect()]
    origins = range(80, 200 - horizon + 1, stride)
    assert sorted(merged) == list(range(80 + horizon - stride, origins[-1] + horizon))


def test_stride_beyond_horizon(spark):
    with pytest.raises(ValueError):
        backtest.origins(frame(spark, {("a", "x"): [1.0]}), "1h", "20230401", 3, 4)


def test_metrics(spark):
    vs, m, start = seasonal(150), 24, 100
    d = frame(spark, {("a", "x"): vs, ("b", "x"): [1.0] * 150, ("c", "x"): [v - 60 for v in vs]})
    fc = naive.seasonal_naive(d, "1h", 1, at(start).isoformat(sep=" "), 10, 5)
    got = {r["ts_id"]: r for r in backtest.evaluate(d, fc, "1h", at(start).isoformat(sep=" "), 10, 5, m).collect()}
    pairs = [(vs[i], vs[i - 24]) for i in range(105, 150)]
    e = [abs(a - f) for a, f in pairs]
    rmse = math.sqrt(statistics.mean(x * x for x in e))
    test = vs[105:]
    scale = statistics.mean(abs(vs[i] - vs[i - m]) for i in range(m, 105))
    want = {
        "mae": statistics.mean(e),
        "rmse": rmse,
        "nrmse_min_max": rmse / (max(test) - min(test)),
        "nrmse_mean": rmse / statistics.mean(test),
        "mape": 100 * statistics.mean(x / a for x, (a, _) in zip(e, pairs)),
        "mase": statistics.mean(e) / scale,
        "smape": 200 * statistics.mean(x / (a + f) for x, (a, f) in zip(e, pairs)),
    }
    assert all(close(got["a"][k], v) for k, v in want.items())
    assert got["b"]["mae"] == 0 and got["b"]["mase"] is None and got["b"]["smape"] == 0
    assert got["c"]["mape"] is None and got["c"]["mae"] is not None
    macro = backtest.metrics_macro(backtest.evaluate(d, fc, "1h", at(start).isoformat(sep=" "), 10, 5, m)).first()
    assert close(macro["mape"], (want["mape"] + 0) / 2)


def test_autoregression_recovers_its_process(spark):
    rnd = random.Random(5)
    z, vs = [0.0, 0.0], [100.0]
    for _ in range(3000):
        z.append(0.2 + 0.6 * z[-1] - 0.3 * z[-2] + rnd.gauss(0, 0.1))
        vs.append(vs[-1] + z[-1])
    d = frame(spark, {("a", "x"): vs, ("b", "x"): [1.0] * 5})
    model = ar.fit_ar(d, "1h", 2, 1, span=100 * HOUR)
    coef = {r["ts_id"]: r["coef"] for r in model.collect()}
    assert coef["b"] is None
    assert np.allclose(coef["a"], [0.2, 0.6, -0.3], atol=0.05)
    every = ar.forecast_ar(d, model, "1h", 2, 1, 5).orderBy("step").collect()
    assert [(r["yhat"], r["reason"]) for r in every if r["ts_id"] == "b"] == [(None, "unfitted")] * 5
    got = [r for r in every if r["ts_id"] == "a"]
    c, w, level = coef["a"], list(np.diff(vs)[-2:]), vs[-1]
    for i, r in enumerate(got):
        nxt = c[0] + c[1] * w[-1] + c[2] * w[-2]
        w, level = [w[-1], nxt], level + nxt
        assert close(r["yhat"], level) and r["ts"] == at(len(vs) + i)


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_integration_undoes_differences(d):
    vs = np.array([3.0 * i**d + 2 for i in range(12)])
    out = ar._extend(vs, np.array([math.factorial(d) * 3.0 if d else 5.0, 0.0]), 1, d, 4)
    want = [3.0 * i**d + 2 if d else 5.0 for i in range(12, 16)]
    assert np.allclose(out, want)


def test_trees_beat_the_naive_forecast(spark):
    d = frame(spark, {("a", "x"): seasonal(900, 1, 8.0), ("b", "x"): seasonal(900, 2, 8.0)})
    start = at(700).isoformat(sep=" ")
    train = d.filter(F.col("ts") < F.lit(start).cast("timestamp_ntz"))
    base = backtest.evaluate(d, naive.seasonal_naive(d, "1h", 1, start, 2), "1h", start, 2)
    for fit in (lambda: trees.fit_forest(train, "1h", 24, 2), lambda: trees.fit_gbt(train, "1h", 24, 2, rounds=10)):
        fc = trees.backtest_rows(fit(), d, "1h", backtest.origins(d, "1h", start, 2))
        got = backtest.evaluate(d, fc, "1h", start, 2)
        pair = got.alias("g").join(base.alias("b"), "ts_id").select("g.mae", "b.mae").collect()
        assert len(pair) == 2 and all(g < b for g, b in pair)


def test_recursion_and_scenarios(spark):
    d = frame(spark, {("a", "x"): seasonal(300, 1, 0.1), ("b", "x"): [10 * v for v in seasonal(300, 2, 0.1)]})
    scaler = prep.fit_minmax(d)
    model = trees.fit_forest(prep.scale(d, scaler), "1h", 24, 5)
    out = trees.forecast(d, model, scaler, "1h", 48)
    rows = out.groupBy("ts_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    assert {(r["n"], r["lo"], r["hi"]) for r in rows} == {(48, at(300), at(347))}
    truth = seasonal(348, 1, 0.0)
    got = [r["yhat"] for r in out.filter("ts_id = 'a'").orderBy("ts").collect()]
    assert statistics.mean(abs(g - t) for g, t in zip(got, truth[300:])) < 6
    assert trees.forecast(d, model, scaler, "1h", 3, "b").select("ts_id").distinct().collect()[0][0] == "b"


def test_paths_draw_every_residual(spark):
    e = frame(spark, {("a", "x"): [float(i) for i in range(10)]}).withColumnRenamed("value", "e")
    fc = frame(spark, {("a", "x"): [100.0] * 40}).select("ts_id", "id", F.col("ts").alias("origin"), F.lit(1).alias("step"), "ts", F.col("value").alias("yhat"))
    draws = paths.sample_paths(fc, e, "1h", 30, seed=1)
    first = sorted(map(tuple, draws.collect()))
    assert len(first) == 1200 and {r[-1] for r in first} == {100.0 + i for i in range(10)}
    assert first == sorted(map(tuple, paths.sample_paths(fc, e, "1h", 30, seed=1).collect()))
    q = paths.quantiles(draws, [0.1, 0.5, 0.9]).collect()
    assert len(q) == 40 and all(r["q_10"] <= r["q_50"] <= r["q_90"] for r in q)


def test_search_space():
    space = {"a": ["list", 1, 2], "b": ["range", 0.1, 0.3, 0.1], "c": ["equal", "a"], "d": 9}
    rows = results.expand_space(space)
    assert len(rows) == 6 and rows[0] == {"a": 1, "b": 0.1, "c": 1, "d": 9} and rows[-1]["b"] == 0.3 and rows[-1]["c"] == 2
    assert [r["x"] for r in results.expand_space({"x": ["range", 2, 6, 2]})] == [2, 4, 6]


def test_trials(spark):
    trials = results.expand_grid(spark, {"days": ["list", *range(1, 31)]})
    a = [r["trial_id"] for r in results.sample_trials(trials, 5, 1).collect()]
    assert len(set(a)) == 5 and a == [r["trial_id"] for r in results.sample_trials(trials, 5, 1).collect()]
    assert set(a) != {r["trial_id"] for r in results.sample_trials(trials, 5, 2).collect()}
    losses = spark.createDataFrame([(1, None), (2, 3.0), (3, 3.0)], "trial_id int, mae double")
    assert results.best_trial(losses, "mae").first()["trial_id"] == 2


def test_windows(spark):
    vs = [float(i) for i in range(50)]
    d = frame(spark, {("a", "x"): vs})
    got = explain.window_dataset(d, "1h", 5, 2).collect()
    assert {tuple(r["steps"]) for r in got} == {tuple(vs[i : i + 5]) for i in range(46)}
    assert 12 <= explain.window_dataset(d, "1h", 5, 2, size=0.5).count() <= 34
    two = frame(spark, {("a", "x"): vs, ("b", "x"): vs})
    some = explain.window_dataset(two, "1h", 5, 2, size=7)
    assert {r["ts_id"]: r["count"] for r in some.groupBy("ts_id").count().collect()} == {"a": 7, "b": 7}
    assert "TakeOrdered" not in some._jdf.queryExecution().executedPlan().toString()
    cov = explain.window_dataset(d, "1h", 5, 2, past=d, future=d)
    r = cov.orderBy("ts").first()
    assert r["past"]["x"] == vs[:7] and r["future"]["x"] == vs[:9] and cov.count() == 42


class Linear:
    """Stands in for a model: yhat = 2 a + 3 b - c, with a product term a * b."""

    def predict_vectors(self, rows):
        from pyspark.ml.functions import vector_to_array

        v = vector_to_array("features")
        return rows.withColumn("yhat", 2 * v[0] + 3 * v[1] - v[2] + v[0] * v[1])


def test_attributions_add_up(spark):
    rows = spark.createDataFrame([("r1", 1.0, 2.0, 3.0), ("r2", -1.0, 0.5, 4.0)], "row_key string, a double, b double, c double")
    base = {"a": 0.5, "b": 1.0, "c": 1.0}
    got = explain.attribute(Linear(), rows, ["a", "b", "c"], base, perms=200, seed=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["row_key"], {})[r["feature"]] = r["attribution"]
    f = lambda a, b, c: 2 * a + 3 * b - c + a * b
    for k, (a, b, c) in {"r1": (1.0, 2.0, 3.0), "r2": (-1.0, 0.5, 4.0)}.items():
        assert close(sum(by[k].values()), f(a, b, c) - f(0.5, 1, 1))
        assert close(by[k]["c"], -(c - 1))
        exact = 2 * (a - 0.5) + (a - 0.5) * (1 + b) / 2
        assert abs(by[k]["a"] - exact) < 0.15
    top = explain.top_features(spark.createDataFrame(got), 2).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"]


def test_background_is_the_median_of_medians(spark):
    d = frame(spark, {("a", "x"): [1.0, 2.0, 9.0], ("b", "x"): [4.0, 4.0, 4.0], ("c", "x"): [6.0, 7.0, 8.0]})
    got = {(r["kind"], r["id"]): r["value"] for r in explain.background(d, d).collect()}
    assert got == {("target", "x"): 4.0, ("covariate", "x"): 4.0}


def test_preparation_runs_end_to_end(spark):
    d = frame(spark, {("GR", "GR"): masked(600, 9, 0.1)}).withColumn("row_id", F.monotonically_increasing_id())
    zones = spark.createDataFrame([("GR", "Europe/Athens")], "country string, tz string")
    for how in ("linear", "historical", "pchip", "none"):
        out = prepare(d, Preparation("1h", to="6h", imputation=how, min_island=3, years=(2023, 2023)), zones)
        assert out.filter("value is not null").count() > 50
        assert out.groupBy("ts_id", "id", "ts").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("n", [1, 37, 5_000])
def test_bottom_of_groups(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice("aaaaab"), rnd.choice([rnd.randrange(16**12), 5, 16**12 - 1]), i) for i in range(3_000)]
    got = explain.bottom(spark.createDataFrame(rows, "g string, k long, i int"), ["g"], n, ["k", "i"]).collect()
    want = [r for g in "ab" for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])[:n]]
    assert sorted(map(tuple, got)) == sorted(want)
