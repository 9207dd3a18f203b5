"""Reports come from the frame that a step worked on; guards hold in the operators themselves."""

import pytest
from helpers import HOUR, at, frame
from pyspark.sql import functions as F

from tidewell.operators import covariates, resample
from tidewell.operators.quality import ValidationError
from tidewell.plans.experiment import Experiment, run_experiment
from tidewell.plans.preparation import Preparation, prepare, prepare_reported


def test_short_islands_are_reported_before_they_go(spark):
    vs = [1.0, 2.0, 3.0, 4.0, *[None] * 5, 7.0, 8.0, *[None] * 5, 1.0, 2.0, 3.0]
    raw = frame(spark, {("a", "x"): vs}).withColumn("row_id", F.lit(0))
    plan = Preparation("1h", std_dev=None, max_thr=2, min_island=2)
    series, reports = prepare_reported(raw, plan)
    assert sorted(r["value"] for r in reports["short_islands"].collect()) == [7.0, 8.0]
    ranges = [(r["range_start"], r["steps"]) for r in reports["residual_ranges"].collect()]
    assert ranges == [(at(4), 12)]
    assert reports["imputed"].count() == 0
    assert sorted(series.collect()) == sorted(prepare(raw, plan).collect())


def test_outliers_are_judged_without_repeated_rows(spark):
    vs = [float(i % 3) for i in range(60)]
    vs[30] = 50.0
    raw = frame(spark, {("a", "x"): vs}).withColumn("row_id", F.lit(0))
    again = raw.filter(F.col("ts") == F.lit(at(10))).withColumns({"row_id": F.lit(1), "value": F.lit(500.0)})
    _, reports = prepare_reported(raw.unionByName(again), Preparation("1h", std_dev=3.0))
    assert [r["value"] for r in reports["outliers"].collect()] == [50.0]
    assert [r["ts"] for r in reports["imputed"].collect()] == [at(30)]


@pytest.mark.parametrize("source", [None, "1h"])
def test_no_finer_target(spark, source):
    d = frame(spark, {("a", "x"): [1.0, 2.0, 3.0, 4.0]})
    with pytest.raises(ValueError, match="finer"):
        resample.resample(d, "15min", source=source)
    with pytest.raises(ValueError, match="finer"):
        prepare(d.withColumn("row_id", F.lit(0)), Preparation("1h", to="15min"))
    with pytest.raises(ValueError, match="finer"):
        covariates.prepare_covariates(d, "1h", to="30min")
    assert resample.resample(d, "2h", source=source).count() > 0
    assert resample.resample(d.limit(1), "15min").count() == 1  # no step to compare with


def test_combine_by_name_or_the_one_component(spark):
    a = frame(spark, {("s", "x"): [1, 2], ("s", "y"): [3, 4], ("t", "x"): [5, 6]})
    b = frame(spark, {("s", "x"): [10, 20], ("s", "y"): [30, 40], ("t", "z"): [50, 60], ("u", "x"): [1, 1]})
    got = {(r["ts_id"], r["id"], r["ts"]): r["value"] for r in covariates.combine(a, b, "-").collect()}
    assert got == {("s", "x", at(0)): -9, ("s", "x", at(1)): -18, ("s", "y", at(0)): -27, ("s", "y", at(1)): -36, ("t", "x", at(0)): -45, ("t", "x", at(1)): -54}


def test_strict_raises_and_untrained_components_have_a_reason(spark):
    vs = [10.0 + i % 24 for i in range(24 * 14)]
    raw = frame(spark, {("a", "x"): vs, ("b", "x"): [None] * (24 * 10) + vs[24 * 10 :]}).withColumn("row_id", F.lit(0))
    e = Experiment(Preparation("1h", std_dev=None), "20230405", "20230410", horizon=24)
    out = run_experiment(raw, e)
    assert {r["reason"] for r in out["forecasts"].filter("ts_id = 'a'").collect()} == {None}
    assert {(r["yhat"], r["reason"]) for r in out["forecasts"].filter("ts_id = 'b'").collect()} == {(None, "unscaled")}
    short = raw.filter(F.col("ts") < F.lit("2023-04-04").cast("timestamp_ntz"))
    assert {r["rule"] for r in run_experiment(short, e)["violations"].collect()} == {"V-13"}
    with pytest.raises(ValidationError, match="V-13"):
        run_experiment(short, Experiment(e.preparation, e.val, e.test, horizon=24, strict=True))
    assert HOUR == 3600
