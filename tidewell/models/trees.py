"""Global tree models over lag features, recursive prediction and scenario inference."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import settle, stored
from ..model import KEYS, seconds, shift
from ..operators.prep import scale, unscale
from .ar import histories, last_values, with_steps, without_forecast
from .features import feature_columns, lag_features, lag_list, step_targets
from .scenario import covariate_reach, with_scenario, within_reach


class LagModel:
    """A fitted tree model with its lags, covariates and output length; one model serves all series.

    ``past`` and ``future`` name covariate columns and their offsets as :func:`lag_features` takes them.
    """

    def __init__(self, model, lags: list[int], horizon: int, past: dict | None = None, future: dict | None = None):
        self.model, self.lags, self.horizon, self.past, self.future = model, lags, horizon, past or {}, future or {}
        self.inputs = [*feature_columns(lags, past, future), "step"]

    @property
    def covariates(self) -> list[str]:
        return list(dict.fromkeys([*self.past, *self.future]))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``yhat`` to rows that hold the input columns; it is NULL where an input is missing."""
        whole = F.lit(True)
        for c in self.inputs:
            whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        out = self.predict_vectors(_assemble(rows, self.inputs, "keep")).drop("features")
        return out.withColumn("yhat", F.when(whole, F.col("yhat")))

    def predict_vectors(self, rows: DataFrame) -> DataFrame:
        return self.model.setFeaturesCol("features").setPredictionCol("yhat").transform(rows)


def _assemble(rows: DataFrame, inputs: list[str], invalid: str = "skip") -> DataFrame:
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid=invalid).transform(rows)


def _columns(past: dict | None, future: dict | None) -> list[str]:
    return [*KEYS, "ts", "value", *dict.fromkeys([*(past or {}), *(future or {})])]


def training_rows(df: DataFrame, res: int | str, lags, horizon: int = 1, past: dict | None = None, future: dict | None = None) -> DataFrame:
    """Complete feature rows, one per (component, timestamp, step)."""
    rows = df.select(*_columns(past, future))
    feats = step_targets(lag_features(rows, res, lags, past, future, horizon), horizon)
    return feats.dropna(subset=[*feature_columns(lags, past, future), "y"])


def _fit(estimator, df: DataFrame, res, lags, horizon: int, past: dict | None, future: dict | None) -> LagModel:
    """The training rows become a table first: growing trees reads them many times."""
    inputs = [*feature_columns(lags, past, future), "step"]
    rows = stored(training_rows(df, res, lags, horizon, past, future).select(*inputs, "y"), "training")
    est = estimator.setFeaturesCol("features").setLabelCol("y").setPredictionCol("yhat")
    return LagModel(est.fit(_assemble(rows, inputs).select("features", "y")), lag_list(lags), horizon, past, future)


def fit_forest(
    df: DataFrame, res: int | str, lags, horizon: int = 1, trees: int = 20, depth: int = 6, seed: int = 0,
    past: dict | None = None, future: dict | None = None,
) -> LagModel:
    """Random forest. Trees differ from those of other learners; check it by its errors, not by equality.

    ``past`` and ``future`` name covariate columns attached to ``df``.
    """
    return _fit(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed), df, res, lags, horizon, past, future)


def fit_gbt(
    df: DataFrame, res: int | str, lags, horizon: int = 1, rounds: int = 20, depth: int = 4, seed: int = 0,
    past: dict | None = None, future: dict | None = None,
) -> LagModel:
    """Gradient-boosted trees, with covariates like :func:`fit_forest`."""
    return _fit(GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed), df, res, lags, horizon, past, future)


def covariate_features(model: LagModel, covs: DataFrame, res: int) -> DataFrame:
    """Covariate inputs of the model by (ts_id, ts), also for the first step after the covariates end."""
    names = feature_columns([], model.past, model.future)
    after = covs.groupBy("ts_id").agg(F.max("ts").alias("ts")).select("ts_id", shift("ts", res).alias("ts"))
    every = covs.select("ts_id", "ts", *model.covariates).unionByName(after, allowMissingColumns=True)
    return lag_features(every.withColumn("id", F.lit("")), res, [], model.past, model.future).select("ts_id", "ts", *names)


def rounds(model: LagModel, state: DataFrame, kept: list[str], res: int, n: int, extra: DataFrame | None = None, shocks: str | None = None) -> DataFrame:
    """The recursion itself: from (keys, ``last_ts``, ``hist``) and ``kept`` columns to the same with ``path``, an array of ``n`` values or
    somewhat more. ``extra`` holds covariate features; ``shocks`` names an array column that is added to the forecasts, step by step,
    before they are fed back. The keys and the kept columns other than ``shocks`` tell rows of the state apart.
    """
    h, longest = model.horizon, max(model.lags)
    keys = [*KEYS, "last_ts", *[c for c in kept if c != shocks]]
    more = ["hist", "path", *([shocks] if shocks else [])]
    state = settle(state.select(*keys, *more[:1], F.expr("cast(array() as array<double>)").alias("path"), *more[2:]))
    for i in range(-(-n // h)):
        now = state
        if extra is not None:
            now = state.withColumn("ts", shift("last_ts", (i * h + 1) * res)).join(extra, ["ts_id", "ts"], "left").drop("ts")
        rows = now.withColumns({f"lag_{k}": F.element_at("hist", -k) for k in model.lags}).withColumn(
            "step", F.explode(F.array(*[F.lit(float(i + 1)) for i in range(h)]))
        )
        rows = model.predict(rows)
        if shocks:
            rows = rows.withColumn("yhat", F.col("yhat") + F.get(shocks, F.lit(i * h) + F.col("step").cast("int") - 1))
        chunk = rows.groupBy(*keys).agg(
            *[F.first(c).alias(c) for c in more], F.sort_array(F.collect_list(F.struct("step", "yhat")))["yhat"].alias("_c")
        )
        new = {"hist": F.slice(F.concat("hist", "_c"), -longest, longest), "path": F.concat("path", "_c")}
        state = settle(chunk.select(*keys, *[new.get(c, F.col(c)).alias(c) for c in more]))
    return state


def predict_recursive(
    model: LagModel, df: DataFrame, res: int | str, n: int, origin_rows: DataFrame | None = None, covs: DataFrame | None = None
) -> DataFrame:
    """Forecast ``n`` steps of every component by feeding forecasts back, one output chunk per round.

    With ``origin_rows`` it starts from every origin in them, for backtests of any horizon. ``covs(ts_id, ts, ...)`` holds
    the columns of the model's covariates, future ones beyond the end of the series; where one is needed and missing the
    forecast and those that build on it are NULL with the reason ``covariates``.

    The state is one row per component and origin (the values before it), so the rounds never touch the history again; every
    round ends in a reliable checkpoint, which keeps the plan short. Components whose last values are too few or
    missing get NULL forecasts with a ``reason``.
    """
    res, longest = seconds(res), max(model.lags)
    if model.covariates and covs is None:
        raise ValueError(f"covariates are needed: {', '.join(model.covariates)}")
    known = last_values(df, res, longest) if origin_rows is None else histories(df, res, longest, origin_rows)
    extra = stored(covariate_features(model, covs, res), "covariates") if model.covariates else None
    state = rounds(model, known.filter("reason is null").select(*KEYS, "last_ts", "hist"), [], res, n, extra)
    out = state.select(*KEYS, "last_ts", F.posexplode(F.slice("path", 1, n)).alias("_i", "yhat"))
    out = out.withColumn("reason", F.when(F.col("yhat").isNull(), "covariates"))
    return with_steps(out.unionByName(without_forecast(known, n)), res)


def forecast(
    df: DataFrame, model: LagModel, scaler: DataFrame, res: int | str, n: int, ts_id: str | None = None,
    covs: DataFrame | None = None, changes: DataFrame | None = None,
) -> DataFrame:
    """Scenario inference: scale with the training scaler, predict ``n`` steps, scale back; all series or one.

    ``covs(ts_id, ts, ...)`` holds the model's covariates on the scale that it was fitted to, ``changes`` what the scenario
    sets otherwise. Steps that they don't reach are NULL, with a ``reason`` that names the covariate that ends first.
    """
    d = df if ts_id is None else df.filter(F.col("ts_id") == ts_id)
    scaled = scale(d.select(*KEYS, "ts", "value"), scaler)
    if covs is not None and changes is not None:
        covs = with_scenario(covs, changes)
    out = unscale(predict_recursive(model, scaled, res, n, covs=covs), scaler, "yhat")
    if not model.covariates:
        return out
    ends = d.groupBy(*KEYS).agg(F.max("ts").alias("last_ts"))
    return within_reach(out, covariate_reach(model, covs, ends, seconds(res), n))


def backtest_rows(model: LagModel, df: DataFrame, res: int | str, origin_rows: DataFrame) -> DataFrame:
    """Forecast all steps of every origin in one batch (direct forecasts, horizon = output length).

    Longer horizons are a matter of :func:`predict_recursive` with the same origins.
    """
    feats = lag_features(df.select(*_columns(model.past, model.future)), res, model.lags, model.past, model.future)
    at = feats.join(origin_rows.withColumnRenamed("origin", "ts"), [*KEYS, "ts"])
    steps = at.withColumn("step", F.explode(F.array(*[F.lit(float(i + 1)) for i in range(model.horizon)])))
    d = model.predict(steps)
    return d.select(
        *KEYS,
        F.col("ts").alias("origin"),
        F.col("step").cast("int").alias("step"),
        shift("ts", (F.col("step").cast("bigint") - 1) * seconds(res)).alias("ts"),
        "yhat",
    )
