"""Lag features and direct multi-step targets on regular grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, seconds
from ..slices import halo_window, with_halo


def lag_list(lags: int | list[int]) -> list[int]:
    """``n`` stands for the lags 1..n; a list gives the lags themselves (positive or negative signs both look back)."""
    return list(range(1, lags + 1)) if isinstance(lags, int) else sorted(abs(k) for k in lags)


def future_offsets(future: int | tuple[int, int] | list[int]) -> list[int]:
    """A pair ``(p, f)`` stands for the offsets -p..f-1, an integer ``n`` for -n..-1."""
    if isinstance(future, int):
        return list(range(-future, 0))
    if isinstance(future, tuple):
        return list(range(-future[0], future[1]))
    return sorted(future)


def feature_columns(lags, past: dict[str, int | list[int]] | None = None, future: dict | None = None) -> list[str]:
    names = [f"lag_{k}" for k in lag_list(lags)]
    names += [f"{c}_lag_{k}" for c, ks in (past or {}).items() for k in lag_list(ks)]
    for c, ks in (future or {}).items():
        names += [f"{c}_{'lead' if k >= 0 else 'lag'}_{abs(k)}" for k in future_offsets(ks)]
    return names


def _offset(column: str, k: int):
    """Value ``k`` steps later (earlier when negative)."""
    w = halo_window()
    if k == 0:
        return F.col(column)
    return (F.lead(column, k) if k > 0 else F.lag(column, -k)).over(w)


def lag_features(
    df: DataFrame,
    res: int | str,
    lags: int | list[int],
    past: dict[str, int | list[int]] | None = None,
    future: dict | None = None,
    horizon: int = 0,
    span: int | None = None,
) -> DataFrame:
    """Lagged values of the target and of covariate columns, for the row at ``ts`` as the first forecast step.

    ``past`` and ``future`` name covariate columns already attached to ``df``. With ``horizon`` the targets of the
    steps are added as ``y_0 .. y_{horizon-1}``. A gap gives NULL features, so training on rows without NULL is the
    same as training on null-free fragments. Everything is one window pass.
    """
    res = seconds(res)
    cols: dict = {f"lag_{k}": _offset("value", -k) for k in lag_list(lags)}
    offsets = [-k for k in lag_list(lags)]
    for c, ks in (past or {}).items():
        cols.update({f"{c}_lag_{k}": _offset(c, -k) for k in lag_list(ks)})
        offsets += [-k for k in lag_list(ks)]
    for c, ks in (future or {}).items():
        cols.update({f"{c}_{'lead' if k >= 0 else 'lag'}_{abs(k)}": _offset(c, k) for k in future_offsets(ks)})
        offsets += future_offsets(ks)
    cols.update({f"y_{h}": _offset("value", h) for h in range(horizon)})
    offsets += list(range(horizon))
    back, ahead = max(0, -min(offsets)), max(0, max(offsets))
    d = with_halo(df, res, back, ahead, span).withColumns(cols).filter("home")
    return d.drop("home", "slice")


def multi_step_targets(df: DataFrame, res: int | str, horizon: int, span: int | None = None) -> DataFrame:
    """Targets ``y_0 .. y_{horizon-1}`` of every row as first forecast step."""
    cols = {f"y_{h}": _offset("value", h) for h in range(horizon)}
    d = with_halo(df, seconds(res), 0, horizon - 1, span).withColumns(cols).filter("home")
    return d.select(*KEYS, "ts", *cols)


def step_targets(features: DataFrame, horizon: int) -> DataFrame:
    """Turn the columns ``y_h`` into rows ``(step, y)``, so that one model learns all steps."""
    steps = F.array(*[F.struct(F.lit(h + 1).cast("double").alias("step"), F.col(f"y_{h}").alias("y")) for h in range(horizon)])
    keep = [c for c in features.columns if not (c.startswith("y_") and c[2:].isdigit())]
    d = features.withColumn("_t", F.explode(steps))
    return d.select(*keep, F.col("_t.step").alias("step"), F.col("_t.y").alias("y"))
