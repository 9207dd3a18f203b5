"""Scenario inference: forecasts under covariates that may be changed and that end somewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, shift
from .features import future_offsets, lag_list


def with_scenario(covs: DataFrame, changes: DataFrame) -> DataFrame:
    """Covariates ``(ts_id, ts, ...)`` with the values of ``changes`` (some of the columns) wherever it has one."""
    own = [c for c in changes.columns if c not in ("ts_id", "ts")]
    unknown = sorted(set(own) - set(covs.columns))
    if unknown:
        raise ValueError(f"not covariates: {', '.join(unknown)}")
    new = changes.select("ts_id", "ts", *[F.col(c).alias(f"_new_{c}") for c in own])
    d = covs.join(new, ["ts_id", "ts"], "full")
    return d.withColumns({c: F.coalesce(f"_new_{c}", c) for c in own}).select(*covs.columns)


def _offsets(model) -> list[tuple[str, list[int]]]:
    out: dict[str, set[int]] = {}
    for c, ks in model.past.items():
        out.setdefault(c, set()).update(-k for k in lag_list(ks))
    for c, ks in model.future.items():
        out.setdefault(c, set()).update(future_offsets(ks))
    return [(c, sorted(ks)) for c, ks in out.items()]


def _known(covs: DataFrame, names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in names])
    d = covs.select("ts_id", "ts", F.explode(cells).alias("_e")).select("ts_id", "ts", "_e.*")
    return d.filter(F.col("v").isNotNull() & ~F.isnan("v")).select("ts_id", "covariate", "ts")


def covariate_reach(model, covs: DataFrame, ends: DataFrame, res: int, n: int) -> DataFrame:
    """How far known covariates carry a forecast of ``n`` steps: ``(ts_id, id, covariate, known_until, steps)``.

    ``ends(ts_id, id, last_ts)`` says where the series end. A round of the recursion needs the covariate at all offsets of
    the model from its first step, so ``steps`` counts those of the rounds before the first one that misses a value. What is
    looked up is a row for each series, round and offset, not the covariates' history.
    """
    wanted = F.array(*[F.struct(F.lit(c).alias("covariate"), F.array(*map(F.lit, ks)).alias("ks")) for c, ks in _offsets(model)])
    starts = F.sequence(F.lit(1), F.lit(n), F.lit(model.horizon))
    need = ends.select(*KEYS, "last_ts", F.explode(wanted).alias("_w")).withColumn("s", F.explode(starts)).withColumn("_k", F.explode("_w.ks"))
    need = need.select(*KEYS, F.col("_w.covariate").alias("covariate"), "s", shift("last_ts", (F.col("s") + F.col("_k")) * res).alias("ts"))
    known = _known(covs, [c for c, _ in _offsets(model)])
    met = known.withColumn("_hit", F.lit(True))
    first = need.join(met, ["ts_id", "covariate", "ts"], "left").groupBy(*KEYS, "covariate")
    first = first.agg((F.coalesce(F.min(F.when(F.col("_hit").isNull(), F.col("s"))), F.lit(n + 1)) - 1).alias("steps"))
    until = known.groupBy("ts_id", "covariate").agg(F.max("ts").alias("known_until"))
    return first.join(until, ["ts_id", "covariate"], "left").select(*KEYS, "covariate", "known_until", "steps")


def within_reach(forecasts: DataFrame, reach: DataFrame, value: str = "yhat") -> DataFrame:
    """Forecasts with NULL beyond the shortest reach of their covariates, and ``reason`` naming the one that ends."""
    short = reach.groupBy(*KEYS).agg(F.min(F.struct("steps", "covariate")).alias("_s"))
    beyond: Column = F.col("step") > F.col("_s.steps")
    why = F.when(beyond, F.concat(F.lit("covariates: "), F.col("_s.covariate"))).otherwise(F.col("reason"))
    d = forecasts.join(short, KEYS, "left")
    return d.withColumns({value: F.when(F.coalesce(beyond, F.lit(False)), F.lit(None)).otherwise(F.col(value)), "reason": F.coalesce(why, "reason")}).drop("_s")
