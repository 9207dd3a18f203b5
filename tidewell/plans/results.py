"""Search spaces, trials, run tables and the selections made from them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import stored
from ..models.naive import seasonal_naive
from .backtest import METRICS, evaluate


def expand_space(space: dict) -> list[dict]:
    """Expand a search space into parameter dictionaries, in the order of the space.

    ``["list", a, b, ...]`` tries every value, ``["range", lo, hi, step]`` every step up to and including ``hi``,
    ``["equal", other]`` copies another parameter; anything else is a constant.
    """
    rows: list[dict] = [{}]
    for name, spec in space.items():
        kind = spec[0] if isinstance(spec, list) and spec else None
        if kind == "equal":
            continue
        if kind == "list":
            values = spec[1:]
        elif kind == "range":
            lo, hi, step = spec[1:]
            count = int((hi - lo) / step + 1e-9) + 1
            values = [lo + i * step if isinstance(lo, int) and isinstance(step, int) else round(lo + i * step, 12) for i in range(count)]
        else:
            values = [spec]
        rows = [{**r, name: v} for r in rows for v in values]
    for r in rows:
        for name, spec in space.items():
            if isinstance(spec, list) and spec and spec[0] == "equal":
                r[name] = r[spec[1]]
    return [{name: r[name] for name in space} for r in rows]


def expand_grid(spark: SparkSession, space: dict) -> DataFrame:
    """The expanded space as ``trials(trial_id, params)``; its size is that of the space, not of any data."""
    rows = [(i, {k: str(v) for k, v in r.items()}) for i, r in enumerate(expand_space(space))]
    return spark.createDataFrame(rows, "trial_id bigint, params map<string,string>")


def sample_trials(trials: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A repeatable random subset of ``n`` trials: those with the smallest MD5 of seed and number."""
    return trials.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial_id").cast("string"))), "trial_id").limit(n)


def score_naive_trials(df: DataFrame, res, days: list[int], start: str, horizon: int, stride: int | None = None, m: int = 1) -> DataFrame:
    """Backtest every seasonality on every series in one job: ``(days, ts_id, metrics)``."""
    fc = seasonal_naive(df, res, days, start, horizon, stride)
    return evaluate(df, fc, res, start, horizon, stride, m, by=("days",))


def score_trials(trials: list[dict], score: Callable[[dict], DataFrame], together: int = 4) -> DataFrame:
    """Fit and score models whose training is itself a Spark job, up to ``together`` trials at a time.

    ``score`` returns the metrics per series of one parameter set. The result has the columns ``trial_id`` and
    ``params`` in front. The metrics of each trial become a table, so no backtest runs twice.
    """

    def one(item: tuple[int, dict]) -> DataFrame:
        i, params = item
        text = F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv])
        return stored(score(params).select(F.lit(i).cast("bigint").alias("trial_id"), text.alias("params"), "*"), "trial")

    with ThreadPoolExecutor(together) as pool:
        scored = list(pool.map(inheritable_thread_target(one), enumerate(trials)))
    return reduce(DataFrame.unionByName, scored)


def best_trial(trials: DataFrame, loss: str, key: str = "trial_id") -> DataFrame:
    """The trial with the smallest loss; undefined losses come last, ties go to the smaller key."""
    return trials.orderBy(F.col(loss).asc_nulls_last(), key).limit(1)


def trials_table(scored: DataFrame, key: str = "days") -> DataFrame:
    """Ledger of the trials: mean metrics over all series, one row per trial."""
    return scored.groupBy(key).agg(F.count("*").alias("n_series"), *[F.avg(c).alias(c) for c in METRICS])


def runs_table(per_series: DataFrame, run: str, experiment: str) -> DataFrame:
    """Metrics in long form ``runs(experiment, run_id, metric, value)``."""
    long = per_series.unpivot([experiment, run], METRICS, "metric", "value")
    return long.select(F.col(experiment).alias("experiment"), F.col(run).cast("string").alias("run_id"), "metric", "value")


def best_run(runs: DataFrame, experiment: str, metric: str) -> DataFrame:
    """The run of an experiment with the smallest value of a metric."""
    d = runs.filter((F.col("experiment") == experiment) & (F.col("metric") == metric) & F.col("value").isNotNull())
    return d.orderBy("value", "run_id").limit(1)


def metric_list(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Labels and values of the metrics of one run (or of each run), in the order of the labels."""
    d = runs if run_id is None else runs.filter(F.col("run_id") == run_id)
    per = d.groupBy("experiment", "run_id").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("_m"))
    return per.select("experiment", "run_id", F.col("_m.metric").alias("labels"), F.col("_m.value").alias("vals"))


def forecast_vs_actual(fc: DataFrame, actual: DataFrame, n: int) -> DataFrame:
    """The last ``n`` forecast rows and, independently, the last ``n`` actual rows."""

    def tail(d: DataFrame, value: str, kind: str) -> DataFrame:
        top = d.orderBy(F.desc("ts"), "ts_id", "id").limit(n)
        return top.select(F.lit(kind).alias("kind"), "ts_id", "id", "ts", F.col(value).alias("value"))

    return tail(fc, "yhat", "forecast").unionByName(tail(actual, "value", "actual"))
