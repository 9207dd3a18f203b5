"""Joint components, scenarios with covariates and exact Shapley values."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from helpers import HOUR, at, frame
from pyspark.sql import functions as F

from tidewell.models import joint, paths, scenario, trees
from tidewell.models.linear import FixedLinear
from tidewell.operators import prep
from tidewell.plans import shapley


def series(spark, values, ts_id="a"):
    """{component: values} as rows; None stays NULL."""
    return frame(spark, {(ts_id, c): vs for c, vs in values.items()})


def covariates(spark, rows, *names):
    return spark.createDataFrame([(s, at(i), *vs) for s, i, *vs in rows], f"ts_id string, ts timestamp_ntz, {', '.join(f'{n} double' for n in names)}")


def cross(n, seed=1):
    """b follows a two steps later; a is noise."""
    rng = random.Random(seed)
    a = [rng.random() for _ in range(n)]
    return {"a": a, "b": [0.0, 0.0, *(10 * x for x in a[:-2])]}


def test_joint_rows_have_all_lags_and_only_own_targets(spark):
    d = series(spark, {"a": [1.0, 2.0, 3.0, 4.0], "b": [10.0, 20.0, None, 40.0]}).unionByName(series(spark, {"b": [5.0, 6.0, 7.0]}, "s"))
    rows = joint.joint_rows(d, HOUR, ["a", "b"], [1], 1)
    got = {(r["ts_id"], r["ts"], r["target"]): (r["y"], r["c0_lag_1"], r["c1_lag_1"], r["has_0"], r["has_1"]) for r in rows.collect()}
    assert got == {
        ("a", at(1), 0): (2.0, 1.0, 10.0, 1.0, 1.0), ("a", at(1), 1): (20.0, 1.0, 10.0, 1.0, 1.0),
        ("a", at(2), 0): (3.0, 2.0, 20.0, 1.0, 1.0),
        ("s", at(1), 1): (6.0, 0.0, 5.0, 0.0, 1.0), ("s", at(2), 1): (7.0, 0.0, 6.0, 0.0, 1.0),
    }


def test_unlisted_component_is_an_error(spark):
    with pytest.raises(Exception, match="not listed: b"):
        joint.wide(series(spark, {"a": [1.0], "b": [2.0]}), ["a"]).collect()


def test_slices_do_not_show(spark):
    d = series(spark, cross(300))
    a, b = (joint.joint_features(d, HOUR, ["a", "b"], [1, 30], 2, span=s).orderBy("ts").collect() for s in (86400, None))
    assert a == b


def test_a_planted_cross_effect_needs_both_components(spark):
    d = series(spark, cross(600))
    known, last = d.filter(F.col("ts") < F.lit(at(500))), d.filter((F.col("ts") >= F.lit(at(500))) & (F.col("ts") < F.lit(at(502))))
    both = joint.fit_joint(known, HOUR, ["a", "b"], 3, size=10, depth=7)
    single = trees.fit_forest(known, HOUR, 3, trees=10, depth=7)

    def error(fc):
        pairs = last.filter("id = 'b'").join(fc.select("id", "ts", "yhat"), ["id", "ts"])
        return pairs.agg(F.avg(F.abs(F.col("value") - F.col("yhat")))).first()[0]

    e_both, e_single = error(joint.predict_joint(both, known, HOUR, 2)), error(trees.predict_recursive(single, known, HOUR, 2))
    assert e_both < 0.3 * e_single


def weights(c):
    return {"": 1.0, "c0_lag_1": 0.5, "c1_lag_2": 0.25} if c == "a" else {"c0_lag_2": -0.5, "c1_lag_1": 0.75, "t_lead_0": 2.0}


def joint_by_hand(a, b, temp, n):
    a, b, out = list(a), list(b), []
    for i in range(n):
        t = temp.get(len(a))
        x, y = 1 + 0.5 * a[-1] + 0.25 * b[-2], None if t is None or a[-2] is None or b[-1] is None else -0.5 * a[-2] + 0.75 * b[-1] + 2 * t
        a, b = [*a, x], [*b, y]
        out.append((x, y))
        if y is None:
            break
    return out


def test_joint_recursion_feeds_all_components_back(spark):
    a, b, temp = [1.0, 4.0, 2.0], [8.0, 3.0, 5.0], {3: 0.5, 4: 1.5, 5: -1.0, 6: 2.0}
    model = joint.fixed_joint(weights, ["a", "b"], 2, future={"t": (0, 1)})
    covs = covariates(spark, [("s", i, v) for i, v in temp.items()], "t")
    got = joint.predict_joint(model, series(spark, {"a": a, "b": b}, "s"), HOUR, 4, covs=covs).collect()
    want = joint_by_hand(a, b, temp, 4)
    assert len(got) == 8
    for r in got:
        assert r["yhat"] == pytest.approx(want[r["step"] - 1]["ab".index(r["id"])])
        assert (r["origin"], r["ts"], r["reason"]) == (at(3), at(2 + r["step"]), None)


def test_joint_origins_gaps_and_missing_components(spark):
    model = joint.fixed_joint(lambda c: {"c0_lag_1": 1.0, "c1_lag_1": 1.0}, ["a", "b"], 1)
    d = series(spark, {"a": [1.0, 2.0, 3.0], "b": [5.0, None, 7.0]}, "s").unionByName(series(spark, {"b": [4.0, 6.0]}, "t"))
    origins = spark.createDataFrame([("s", at(1)), ("s", at(2)), ("t", at(1))], "ts_id string, origin timestamp_ntz")
    got = {(r["ts_id"], r["id"], r["origin"], r["step"]): (r["yhat"], r["reason"]) for r in joint.predict_joint(model, d, HOUR, 2, origins).collect()}
    assert got == {
        ("s", "a", at(1), 1): (6.0, None), ("s", "b", at(1), 1): (6.0, None), ("s", "a", at(1), 2): (12.0, None), ("s", "b", at(1), 2): (12.0, None),
        **{("s", c, at(2), k): (None, "missing") for c in "ab" for k in (1, 2)},
        ("t", "b", at(1), 1): (4.0, None), ("t", "b", at(1), 2): (4.0, None),
    }


def test_scenario_stops_where_a_covariate_ends(spark):
    model = FixedLinear({"lag_1": 1.0, "t_lag_1": 1.0, "u_lead_1": 10.0}, 1, past={"t": 1}, future={"u": [0, 1]})
    d = series(spark, {"x": [1.0, 3.0]}, "p").unionByName(series(spark, {"x": [5.0, 9.0]}, "q"))
    scaler = stored_scaler = prep.fit_minmax(d.withColumn("split", F.lit("train")))
    rows = [("p", i, 1.0, 2.0) for i in range(6)] + [("q", i, 1.0, 2.0 if i < 4 else None) for i in range(6)]
    covs = covariates(spark, rows, "t", "u")
    got = {(r["ts_id"], r["step"]): (r["yhat"], r["reason"]) for r in trees.forecast(d, model, scaler, HOUR, 3, covs=covs).collect()}
    # scaled last value 1; every step adds t = 1 and 10 * u = 20; back on the scale 2 * x + 1 and 4 * x + 5
    assert got == {("p", 1): (45.0, None), ("p", 2): (87.0, None), ("p", 3): (129.0, None), ("q", 1): (93.0, None), ("q", 2): (None, "covariates: u"), ("q", 3): (None, "covariates: u")}
    reach = scenario.covariate_reach(model, covs, d.groupBy("ts_id", "id").agg(F.max("ts").alias("last_ts")), HOUR, 3)
    assert {(r["ts_id"], r["covariate"], r["steps"]) for r in reach.collect()} == {("p", "t", 3), ("p", "u", 3), ("q", "t", 3), ("q", "u", 1)}
    changes = covariates(spark, [("q", 4, 0.0), ("q", 3, 1.0)], "u")
    again = {(r["ts_id"], r["step"]): r["yhat"] for r in trees.forecast(d, model, stored_scaler, HOUR, 3, "q", covs, changes).collect()}
    assert again == {("q", 1): 4 * (1 + 1 + 10.0) + 5, ("q", 2): 4 * (12 + 1 + 0.0) + 5, ("q", 3): None}


def test_model_without_covariates_needs_none(spark):
    model = FixedLinear({"lag_1": 2.0}, 1)
    d = series(spark, {"x": [0.0, 1.0]})
    got = trees.forecast(d, model, prep.fit_minmax(d.withColumn("split", F.lit("train"))), HOUR, 2).collect()
    assert [r["yhat"] for r in sorted(got, key=lambda r: r["step"])] == [2.0, 4.0]
    with pytest.raises(ValueError, match="covariates are needed"):
        trees.predict_recursive(FixedLinear({}, 1, past={"t": 1}), d, HOUR, 1)


def brute(predict, x, base, f):
    """Shapley values over all subsets."""
    out = np.zeros(f)
    for i in range(f):
        rest = [j for j in range(f) if j != i]
        for k in range(f):
            for own in combinations(rest, k):
                z = base.copy()
                z[list(own)] = x[list(own)]
                with_i = z.copy()
                with_i[i] = x[i]
                out[i] += math.factorial(k) * math.factorial(f - k - 1) / math.factorial(f) * (predict(with_i) - predict(z))
    return out


def predict(of, z):
    return sum(t.value for t in of if all(lo < z[f] <= hi for f, lo, hi in zip(t.features, t.low, t.high, strict=True)))


@pytest.mark.parametrize("fit", [trees.fit_forest, trees.fit_gbt])
def test_exact_values_equal_all_subsets(spark, fit):
    rng = random.Random(3)
    d = series(spark, {"x": [math.sin(i / 3) * 5 + rng.random() for i in range(400)]})
    size = {"trees": 6} if fit is trees.fit_forest else {"rounds": 6}
    model = fit(d, HOUR, 7, 2, depth=4, **size)
    of = shapley.leaves(model.model)
    rows = trees.training_rows(d, HOUR, 7, 2).limit(12).withColumn("row_key", F.concat_ws("|", F.col("ts").cast("string"), "step")).cache()
    base = {c: 0.5 for c in model.inputs}
    got = {}
    for r in shapley.attribute_exact(model, rows, model.inputs, base).collect():
        got.setdefault(r["row_key"], {})[r["feature"]] = r["attribution"]
    ground = np.array([base[c] for c in model.inputs])
    for r in model.predict(rows).collect():
        x = np.array([float(r[c]) for c in model.inputs])
        assert predict(of, x) == pytest.approx(r["yhat"], abs=1e-9)  # the leaves are the model
        want = brute(lambda z: predict(of, z), x, ground, len(x))
        assert [got[r["row_key"]][c] for c in model.inputs] == pytest.approx(want, abs=1e-9)
        assert sum(want) == pytest.approx(r["yhat"] - predict(of, ground), abs=1e-9)


def test_fixed_features_are_no_players(spark):
    of = [shapley.leaf({0: (-np.inf, 1), 1: (-np.inf, 0)}, 4.0), shapley.leaf({0: (1, np.inf)}, 2.0), shapley.leaf({}, 7.0)]
    rows = spark.createDataFrame([(1, 2.0, -1.0), (2, 0.5, -1.0), (3, 0.5, None)], "row_key int, a double, b double")
    got = {(r["row_key"], r["feature"]): r["attribution"] for r in shapley.attribute_exact(of, rows, ["a", "b"], {"a": 0.0}).collect()}
    assert got == {(1, "a"): -2.0, (2, "a"): 0.0, (3, "a"): None}


def test_linear_values(spark):
    model = FixedLinear({"lag_1": 2.0, "lag_2": -1.0}, 2)
    rows = spark.createDataFrame([("r", 3.0, 5.0, 1.0)], "row_key string, lag_1 double, lag_2 double, step double")
    got = {r["feature"]: r["attribution"] for r in shapley.attribute_exact(model, rows, model.inputs, {"lag_1": 1.0, "lag_2": 1.0, "step": 1.0}).collect()}
    assert got == {"lag_1": 4.0, "lag_2": -4.0, "step": 0.0}


def test_paths_inside_the_recursion_widen(spark):
    d = series(spark, {"x": [float(i % 2) for i in range(50)], "y": [1.0, None]}).unionByName(series(spark, {"z": [1.0, 2.0]}, "no_residuals"))
    e = d.filter("id = 'x'").select("ts_id", "id", "ts", (F.col("value") * 2 - 1).alias("e"))  # +1 and -1 as often
    walk = FixedLinear({"lag_1": 1.0}, 1)
    drawn = paths.recursive_paths(walk, d, e, HOUR, 25, 200, seed=4)
    q = {r["step"]: r["q_90"] - r["q_10"] for r in paths.quantiles(drawn.filter("id = 'x'"), [0.1, 0.9]).collect()}
    assert q[1] == 2 and 2 < q[4] < q[25]
    ends = [r["yhat"] for r in drawn.filter("id = 'x' and step = 25").collect()]
    assert len(ends) == 200 and 4 < np.std(ends) < 6.2  # the square root of 25
    assert sorted(map(tuple, drawn.filter("id = 'x'").collect())) == sorted(map(tuple, paths.recursive_paths(walk, d, e, HOUR, 25, 200, seed=4).filter("id = 'x'").collect()))
    lost = drawn.filter("id <> 'x'").groupBy("ts_id", "id").agg(F.count(F.lit(1)).alias("n"), F.count("yhat").alias("k")).collect()
    assert {(r["ts_id"], r["id"], r["n"], r["k"]) for r in lost} == {("a", "y", 5000, 0), ("no_residuals", "z", 5000, 0)}
