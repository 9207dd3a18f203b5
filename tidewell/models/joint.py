"""Models that forecast all components of a series from the lags of all of them.

A feature row belongs to (ts_id, ts): the lags of every component side by side, covariates, and for each component whether
the series has it. Series may have different components (of one list): what a series lacks is 0 in the lags with
the mark ``has_<i>`` = 0, and is neither learned nor forecast. Rows are assembled inside time slices with halos, so one long
series is spread over many tasks. Each component has a learner of its own, fitted to the same stored rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import settle, stored
from ..model import KEYS, listed, seconds, shift
from .ar import histories, last_values
from .features import feature_columns, lag_features, lag_list
from .linear import FixedLinear
from .trees import LagModel, _assemble, covariate_features


def names(components: list[str]) -> list[str]:
    """Column names of the components, by position: ids may hold any characters."""
    return [f"c{i}" for i in range(len(components))]


def wide(df: DataFrame, components: list[str]) -> DataFrame:
    """One row per (ts_id, ts) with ``c<i>`` for each component and ``has_<i>``; other ids are an error."""
    d = df.select("ts_id", listed("id", components).alias("id"), "ts", "value")
    own = [F.col("id") == c for c in components]
    rows = d.groupBy("ts_id", "ts").agg(*[F.max(F.when(o, F.col("value"))).alias(c) for o, c in zip(own, names(components), strict=True)])
    has = d.groupBy("ts_id").agg(*[F.max(o.cast("double")).alias(f"has_{i}") for i, o in enumerate(own)])
    filled = {c: F.when(F.col(f"has_{i}") == 0, F.lit(0.0)).otherwise(F.col(c)) for i, c in enumerate(names(components))}
    return rows.join(has, "ts_id").withColumns(filled)


def inputs(components: list[str], lags, past: dict | None = None, future: dict | None = None) -> list[str]:
    own = feature_columns([], dict.fromkeys(names(components), lag_list(lags)))
    return [*own, *feature_columns([], past, future), *[f"has_{i}" for i in range(len(components))], "step"]


def joint_features(
    df: DataFrame, res: int | str, components: list[str], lags, horizon: int = 0,
    past: dict | None = None, future: dict | None = None, covs: DataFrame | None = None, span: int | None = None,
) -> DataFrame:
    """(ts_id, ts) with ``c<i>_lag_<k>``, covariate features, ``has_<i>`` and, with a horizon, targets ``c<i>_lead_<h>``.

    ``covs(ts_id, ts, ...)`` holds the covariate columns that ``past`` and ``future`` name.
    """
    d = wide(df, components)
    if covs is not None:
        d = d.join(covs, ["ts_id", "ts"], "left")
    own = names(components)
    back = {**dict.fromkeys(own, lag_list(lags)), **(past or {})}
    ahead = {**({c: list(range(horizon)) for c in own} if horizon else {}), **(future or {})}
    d = d.withColumns({"id": F.lit(""), "value": F.lit(None).cast("double")})
    out = lag_features(d, res, [], back, ahead, span=span)
    has = [f"has_{i}" for i in range(len(components))]
    targets = [f"{c}_lead_{h}" for c in own for h in range(horizon)]
    return out.select("ts_id", "ts", *feature_columns([], back, future), *has, *targets)


def joint_rows(
    df: DataFrame, res: int | str, components: list[str], lags, horizon: int = 1,
    past: dict | None = None, future: dict | None = None, covs: DataFrame | None = None,
) -> DataFrame:
    """Complete training rows: (ts_id, ts, target, step, y) and the inputs; ``target`` is the position of the component."""
    d = joint_features(df, res, components, lags, horizon, past, future, covs)
    goal = F.array(*[
        F.struct(F.lit(i).alias("target"), F.lit(float(h + 1)).alias("step"), F.col(f"{c}_lead_{h}").alias("y"), F.col(f"has_{i}").alias("own"))
        for i, c in enumerate(names(components)) for h in range(horizon)
    ])
    d = d.withColumn("_g", F.explode(goal)).select("*", "_g.target", "_g.step", "_g.y", "_g.own").filter("own = 1")
    kept = inputs(components, lags, past, future)
    return d.dropna(subset=[*kept, "y"]).select("ts_id", "ts", "target", "y", *kept)


class JointModel:
    """One learner for each component (None for one that no training row has), with what they have in common."""

    def __init__(self, learners: list[LagModel | None], components: list[str], lags, horizon: int, past: dict | None = None, future: dict | None = None):
        self.learners, self.components, self.lags, self.horizon = learners, components, lag_list(lags), horizon
        self.past, self.future = past or {}, future or {}

    @property
    def covariates(self) -> list[str]:
        return list(dict.fromkeys([*self.past, *self.future]))


def _learner(components: list[str], lags, horizon: int, past: dict | None, future: dict | None, model) -> LagModel:
    out = LagModel(model, lag_list(lags), horizon, past, future)
    out.inputs = inputs(components, lags, past, future)
    return out


def fit_joint(
    df: DataFrame, res: int | str, components: list[str], lags, horizon: int = 1, kind: str = "forest", size: int = 20, depth: int = 6, seed: int = 0,
    past: dict | None = None, future: dict | None = None, covs: DataFrame | None = None,
) -> JointModel:
    """Forest (``size`` trees) or boosted trees (``size`` rounds) for every component from the lags of all."""
    if kind == "forest":
        est = RandomForestRegressor(numTrees=size, maxDepth=depth, seed=seed)
    else:
        est = GBTRegressor(maxIter=size, maxDepth=depth, seed=seed)
    est = est.setFeaturesCol("features").setLabelCol("y").setPredictionCol("yhat")
    rows = stored(joint_rows(df, res, components, lags, horizon, past, future, covs), "joint_training")
    seen = {r["target"] for r in rows.select("target").distinct().collect()}  # at most one a component
    kept = inputs(components, lags, past, future)
    learners: list[LagModel | None] = []
    for i in range(len(components)):
        own = _assemble(rows.filter(F.col("target") == i), kept).select("features", "y")
        learners.append(_learner(components, lags, horizon, past, future, est.fit(own)) if i in seen else None)
    return JointModel(learners, components, lags, horizon, past, future)


def _row(components: list[str]) -> Column:
    return F.array(*[F.col(c) for c in names(components)])


def predict_joint(
    model: JointModel, df: DataFrame, res: int | str, n: int, origin_rows: DataFrame | None = None, covs: DataFrame | None = None
) -> DataFrame:
    """Forecast ``n`` steps of all components of every series together: ``(ts_id, id, origin, step, ts, yhat, reason)``.

    The forecasts of all components are fed back, one output chunk per round; the state is one row per series and origin.
    The forecast begins after the last row of the series, or at each origin of ``origin_rows(ts_id, origin)``. A component that
    ends earlier, or a gap among the last values, gives NULL forecasts for the whole series with a ``reason``, for all components
    depend on it.
    """
    res, h, longest = seconds(res), model.horizon, max(model.lags)
    if model.covariates and covs is None:
        raise ValueError(f"covariates are needed: {', '.join(model.covariates)}")
    d = wide(df, model.components)
    has = [f"has_{i}" for i in range(len(model.components))]
    marks = d.groupBy("ts_id").agg(*[F.max(c).alias(c) for c in has])
    d = d.select("ts_id", F.lit("").alias("id"), "ts", _row(model.components).alias("value"))
    if origin_rows is None:
        known = last_values(d, res, longest)
    else:
        known = histories(d, res, longest, origin_rows.select("ts_id", "origin").distinct().withColumn("id", F.lit("")))
    gap = F.exists("hist", lambda x: x.isNull() | F.exists(x, lambda v: v.isNull()))
    known = known.withColumn("reason", F.coalesce("reason", F.when(gap, F.lit("missing"))))
    known = settle(known.select(*KEYS, "last_ts", "hist", "reason").join(marks, "ts_id"))
    extra = stored(covariate_features(model, covs, res), "covariates") if model.covariates else None
    state = known.filter("reason is null").drop("reason").withColumn("path", F.expr("cast(array() as array<array<double>>)"))
    lagged = {f"{c}_lag_{k}": F.element_at(F.element_at("hist", -k), i + 1) for i, c in enumerate(names(model.components)) for k in model.lags}
    keep = [*KEYS, "last_ts", *has, "hist", "path"]
    for i in range(-(-n // h)):
        now = state
        if extra is not None:
            now = now.withColumn("ts", shift("last_ts", (i * h + 1) * res)).join(extra, ["ts_id", "ts"], "left").drop("ts")
        rows = now.withColumns(lagged).withColumn("step", F.explode(F.array(*[F.lit(float(j + 1)) for j in range(h)])))
        for j, learner in enumerate(model.learners):
            own = F.col("yhat") if learner is not None else F.lit(None).cast("double")
            rows = rows if learner is None else learner.predict(rows)
            rows = rows.withColumn(f"_y{j}", F.when(F.col(f"has_{j}") == 0, F.lit(0.0)).otherwise(own)).drop("yhat")
        y = F.array(*[F.col(f"_y{j}") for j in range(len(model.learners))])
        chunk = rows.groupBy(*KEYS, "last_ts").agg(
            *[F.first(c).alias(c) for c in (*has, "hist", "path")], F.sort_array(F.collect_list(F.struct("step", y.alias("y"))))["y"].alias("_c")
        )
        chunk = chunk.withColumns({"path": F.concat("path", "_c"), "hist": F.slice(F.concat("hist", "_c"), -longest, longest)})
        state = settle(chunk.select(*keep))
    done = state.select("ts_id", "last_ts", *has, F.posexplode(F.slice("path", 1, n)).alias("_i", "_y"))
    done = done.withColumn("reason", F.lit(None).cast("string"))
    lost = known.filter("reason is not null").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lost = lost.select("ts_id", "last_ts", *has, "_i", F.lit(None).cast("array<double>").alias("_y"), "reason")
    each = [F.struct(F.lit(c).alias("id"), F.col(f"has_{i}").alias("own"), F.element_at("_y", i + 1).alias("yhat")) for i, c in enumerate(model.components)]
    out = done.unionByName(lost).withColumn("_e", F.explode(F.array(*each))).select("ts_id", "last_ts", "_i", "reason", "_e.*").filter("own = 1")
    reason = F.coalesce("reason", F.when(F.col("yhat").isNull(), F.lit("covariates" if model.covariates else "missing")))
    step = F.col("_i") + 1
    return out.select(
        "ts_id", "id", shift("last_ts", res).alias("origin"), step.alias("step"), shift("last_ts", step * res).alias("ts"), "yhat", reason.alias("reason")
    )


def fixed_joint(weights: Callable[[str], dict[str, float]], components: list[str], lags, past: dict | None = None, future: dict | None = None) -> JointModel:
    """A joint model of given weights: ``weights(component)`` by input name, with ``""`` for the constant."""
    learners = []
    for c in components:
        own = FixedLinear(weights(c), lags, 1, past, future)
        own.inputs = inputs(components, lags, past, future)
        learners.append(own)
    return JointModel(learners, components, lags, 1, past, future)

