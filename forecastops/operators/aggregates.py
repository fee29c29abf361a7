"""Grouped aggregates. All reduce map-side before they shuffle, so hot groups arrive as partial results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_by(df: DataFrame, keys: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """SUM of many columns; a group of missing values sums to NULL."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def max_by_group(df: DataFrame, keys: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def group_keyed(df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), means: Sequence[str] = ()) -> DataFrame:
    """Sums and means per group under data-frame rules: rows with a missing key are left out and the sum
    of missing values is zero."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums] + [F.avg(c).alias(c) for c in means]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*aggs)


def mean_by(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """Mean per group, rows with a missing key left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(value).alias(name or value))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def range_summary(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("first"), F.max(col).alias("last"), F.count(F.lit(1)).alias("rows"))


def pivot_sum(df: DataFrame, keys: Sequence[str], pivot: str, values: Mapping[object, str], value: str) -> DataFrame:
    """Long to wide for a declared list of pivot values.

    Declared values save the pass that would look for them, and the columns become conditional
    aggregates: one shuffle however many there are.
    """
    wide = [F.sum(F.when(F.col(pivot) == v, F.col(value))).alias(name) for v, name in values.items()]
    return df.groupBy(*keys).agg(*wide)


def found_values(df: DataFrame, col: str, limit: int) -> list | None:
    """The different values of a column in order, null left out; None where there are more than ``limit``."""
    rows = df.where(F.col(col).isNotNull()).select(col).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(r[0] for r in rows)


def pivot_found(df: DataFrame, keys: Sequence[str], pivot: str, value: str, prefix: str = "", limit: int = 200) -> DataFrame:
    """Long to wide over the values that the table holds.

    Two phases: the values, at most ``limit`` of them reach the driver, and then one conditional aggregate. With more
    values a wide table would grow with the data: the result is then long, with the sum of every key and value.
    Rows whose pivot value is null belong to no column but keep their key.
    """
    values = found_values(df, pivot, limit)
    if values is None:
        return sum_by(df, [*keys, pivot], [value])
    return pivot_sum(df, keys, pivot, {v: f"{prefix}{v}" for v in values}, value)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long, one row per value column."""
    return df.unpivot(list(ids), list(values), name, value)


def union_all(tables: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    """Union by column name; with ``fill_missing`` absent columns become NULL."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=fill_missing)
    return first
