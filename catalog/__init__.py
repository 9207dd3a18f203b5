"""Queries over the shared tables, one per operator, with the SQL they are checked against."""

from . import cleaning, experiments, features, forecasting, quality, scenarios, selection, sources  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
