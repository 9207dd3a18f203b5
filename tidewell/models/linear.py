"""Linear models of given weights: for scenarios of known effects, and as a yardstick for everything that takes a model."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import lag_list
from .trees import LagModel


class FixedLinear(LagModel):
    """``weights`` by input name, with ``""`` for the constant; inputs without a weight have none."""

    def __init__(self, weights: dict[str, float], lags, horizon: int = 1, past: dict | None = None, future: dict | None = None):
        super().__init__(None, lag_list(lags), horizon, past, future)
        self.weights = weights

    def _sum(self, value) -> Column:
        out = F.lit(float(self.weights.get("", 0.0)))
        for i, c in enumerate(self.inputs):
            if c in self.weights:
                out = out + F.lit(float(self.weights[c])) * value(i, c)
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        """``yhat``, NULL where an input with a weight is missing."""
        return rows.withColumn("yhat", self._sum(lambda _, c: F.col(c)))

    def predict_vectors(self, rows: DataFrame) -> DataFrame:
        d = rows.withColumn("_v", vector_to_array("features"))
        return d.withColumn("yhat", self._sum(lambda i, _: F.col("_v")[i])).drop("_v")
