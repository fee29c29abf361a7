"""Registered queries and the SQL each one must agree with."""

from forecastops.catalog import basics, comparisons, models, ordered, relational, reports  # noqa: F401
from forecastops.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
