"""Number expressions with explicit missing-value rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "clip", "half_even", "nan_to_null", "percent_change", "row_total", "row_total_strict", "to_count",
    "to_number", "trend_label", "zero_to_null",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Double, NULL for text that is no number and for NaN."""
    return nan_to_null(_col(c).try_cast("double"))


def to_count(c) -> Column:
    """Whole number, NULL for text that is none."""
    return _col(c).try_cast("bigint")


def nan_to_null(c) -> Column:
    """Missing is NULL only: a NaN would poison avg and max."""
    return F.nullif(_col(c), F.lit(float("nan")))


def zero_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(0))


def row_total(cols: Sequence[str | Column]) -> Column:
    """Sum across columns where missing counts as zero; zero when all are missing."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c), F.lit(0)) for c in cols])


def row_total_strict(cols: Sequence[str | Column]) -> Column:
    """Sum across columns, NULL when any is missing."""
    return reduce(lambda a, b: a + b, [_col(c) for c in cols])


def clip(c, low=None, high=None) -> Column:
    """Value held inside ``[low, high]``; missing stays missing, a missing bound does not bind."""
    value = _col(c)
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), out)


def half_even(c, digits: int = 0) -> Column:
    """Banker's rounding."""
    return F.bround(_col(c), digits)


def percent_change(base, target) -> Column:
    """``(target - base) / base * 100``; NULL when the base is zero or missing."""
    b, t = _col(base), _col(target)
    return F.try_divide(t - b, b) * 100


def trend_label(change, band: float = 1.0) -> Column:
    """Direction of a percent change, level inside ``±band``."""
    c = _col(change)
    return F.when(c > band, "Increase").when(c < -band, "Decrease").otherwise("No Significant Change")
