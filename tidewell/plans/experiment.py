"""One experiment from one parameter object: prepare, split, scale, fit, backtest, scale back, score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..model import KEYS
from ..models import ar, naive, trees
from ..operators import quality
from ..operators.clean import cut_common_span
from ..operators.prep import fit_minmax, scale, split, unscale
from ..operators.resample import coarser
from . import backtest
from .preparation import Preparation, prepare_reported

MODELS = ("naive", "ar", "forest", "gbt")


@dataclass(frozen=True)
class Experiment:
    """What to run. ``options`` go to the model: ``days``; ``p``, ``d``; ``lags``, ``output``, ``past``, ``future``."""

    preparation: Preparation
    val: str
    test: str
    end: str | None = None
    model: str = "naive"
    options: dict = field(default_factory=dict)
    horizon: int = 24
    stride: int | None = None
    m_mase: int = 1
    common_span: bool = True
    scaled: bool = True
    strict: bool = False

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"the model is one of {', '.join(MODELS)}")
        if self.preparation.to is not None:
            coarser(self.preparation.res, self.preparation.to)

    @property
    def res(self) -> int | str:
        return self.preparation.to or self.preparation.res


def _forecasts(e: Experiment, d: DataFrame, known: DataFrame, covs: DataFrame | None) -> DataFrame:
    """Forecasts of every origin of the test set by a model fitted to ``known``."""
    if e.model == "naive":
        return naive.seasonal_naive(d, e.res, e.options.get("days", 1), e.test, e.horizon, e.stride)
    origin = backtest.origins(d, e.res, e.test, e.horizon, e.stride)
    if e.model == "ar":
        p, diff = e.options.get("p", 12), e.options.get("d", 1)
        return ar.forecast_ar(d, ar.fit_ar(known, e.res, p, diff), e.res, p, diff, e.horizon, origin)
    past, future = e.options.get("past"), e.options.get("future")
    rows = known if covs is None else known.join(covs, ["ts_id", "ts"], "left")
    fit = trees.fit_forest if e.model == "forest" else trees.fit_gbt
    model = fit(rows, e.res, e.options.get("lags", 24), e.options.get("output", 1), past=past, future=future)
    return trees.predict_recursive(model, d, e.res, e.horizon, origin, covs)


def run_experiment(raw: DataFrame, e: Experiment, tz_map: DataFrame | None = None, holidays: DataFrame | None = None, covs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The prepared ``series``, ``forecasts``, ``actuals`` of the test set and ``metrics`` per series, with scaling also the ``scaler``
    and ``scaled_forecasts``; ``violations`` of the rules for validation and test sets; the reports of the preparation.

    ``covs(ts_id, ts, ...)`` holds covariate columns on the grid of the prepared series. The model is fitted to all that
    lies before the test set, the scaler to the training set. A component without training values has no scaler: its forecasts are
    NULL with the reason ``unscaled``. With ``strict`` the first violation is raised before anything is fitted.
    """
    series, reports = prepare_reported(raw, e.preparation, tz_map, holidays)
    series = stored(cut_common_span(series) if e.common_span else series, "series")
    parts = split(series, e.val, e.test, e.end)
    rules = (quality.v_ends_before_val(series, e.val), quality.v_nulls_after_val(series, e.val), quality.v_nan_in_set(parts))
    violations = None
    for i, r in enumerate(rules):
        r = r.withColumn("order", F.lit(i))
        violations = r if violations is None else violations.unionByName(r)
    if e.strict:
        quality.assert_valid(violations)
    d = parts.filter("split = 'train' or split = 'val' or split = 'test'").select(*KEYS, "ts", "value", "split")
    if e.val == e.test:
        d = d.filter("split <> 'val'")
    whole, known = d.drop("split"), d.filter("split <> 'test'").drop("split")
    out = {"series": series, "violations": violations, "actuals": d.filter("split = 'test'").drop("split"), **reports}
    if e.scaled:
        scaler = stored(fit_minmax(d), "scaler")
        own = stored(_forecasts(e, stored(scale(whole, scaler), "scaled"), scale(known, scaler), covs), "scaled_forecasts")
        fc = unscale(own, scaler, "yhat").join(scaler.filter("lo is not null").select(*KEYS, F.lit(True).alias("_has")), KEYS, "left")
        reason = F.when(F.col("_has").isNull(), "unscaled")
        fc = fc.withColumn("reason", F.coalesce(reason, "reason") if "reason" in own.columns else reason).drop("_has")
        out |= {"scaler": scaler, "scaled_forecasts": own}
    else:
        fc = _forecasts(e, whole, known, covs)
    fc = stored(fc, "forecasts")
    return out | {"forecasts": fc, "metrics": backtest.evaluate(whole, fc, e.res, e.test, e.horizon, e.stride, e.m_mase)}
