"""Cleaning and feature preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.functions import (at_time, clip, day_type, hhmm_hour, hhmm_number, hhmm_text, is_weekend, keyed_normal,
                                   row_total, time_text, to_number, weekday_monday0, zero_to_null)
from forecastops.operators.aggregates import group_keyed
from forecastops.operators.joins import calendar_side, measured_side, small_side
from forecastops.operators.quantiles import exact_quantiles
from forecastops.session import cut_lineage

CALENDAR_PARTS = ("month", "week", "day_of_week", "day_of_year", "hour", "year")


def reshape_hourly(df: DataFrame, vehicles: Sequence[str], date: str = "date", time: str = "time",
                   facility: str = "facility") -> DataFrame:
    """Raw lane counts to ``date, time, facility, total_vehicles, hour, dayofweek, day_type``.

    One projection of built-in expressions: vehicle classes are cast before they are added, rows whose
    time is no number are dropped, ``2400`` and the like keep their row but have no hour.
    """
    day = F.col(date).try_cast("date")
    return df.filter(hhmm_number(time).isNotNull()).select(
        day.alias("date"), hhmm_text(time).alias("time"), F.col(facility).alias("facility"),
        row_total([to_number(v) for v in vehicles]).alias("total_vehicles"), hhmm_hour(time).alias("hour"),
        weekday_monday0(day).alias("dayofweek"), day_type(day).alias("day_type"))


def hourly_features(df: DataFrame, vehicles: Sequence[str], date: str = "date", time: str = "time") -> DataFrame:
    """Timestamp, vehicle total and calendar parts of raw lane counts."""
    out = df.select("*", *[to_number(v).alias(f"__{v}") for v in vehicles]).drop(*vehicles)
    out = out.withColumnsRenamed({f"__{v}": v for v in vehicles})
    out = out.withColumn("ts", at_time(F.col(date).try_cast("date"), time))
    return out.select(
        "*", row_total(vehicles).alias("total_vehicles"), F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"),
        F.month("ts").alias("month"), F.year("ts").alias("year"), weekday_monday0("ts").alias("dayofweek"),
        is_weekend("ts").alias("is_weekend"))


def hourly_by_facility(df: DataFrame, sums: Sequence[str], means: Sequence[str] = (), facility: str = "facility",
                       ts: str = "ts") -> DataFrame:
    """Volumes summed and weather averaged per facility and timestamp, with calendar parts added back."""
    out = group_keyed(df, [facility, ts], sums, means)
    return out.select(
        "*", F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), F.year(ts).alias("year"), F.month(ts).alias("month"),
        weekday_monday0(ts).alias("day_of_week"), time_text(ts).alias("time"))


def _wide_medians(df: DataFrame, by: Sequence[str], cols: Sequence[str], suffix: str, monthly: bool) -> DataFrame:
    """Exact medians of many columns per group, computed together.

    A monthly table is bounded by the calendar and uses the built-in median. Otherwise the columns are
    stacked and the quantiles of all of them come from one pass that no group can overload.
    """
    if monthly:
        return df.groupBy(*by).agg(*[F.median(c).alias(f"{c}{suffix}") for c in cols])
    long = df.select(*by, *cols).unpivot(list(by), list(cols), "__col", "__val")
    medians = exact_quantiles(long, [*by, "__col"], "__val", {"__q": 0.5})
    wide = [F.max(F.when(F.col("__col") == c, F.col("__q"))).alias(f"{c}{suffix}") for c in cols]
    return medians.groupBy(*by).agg(*wide)


@dataclass(frozen=True)
class SeasonalImputer:
    """Fill values per season and column, plus one overall value per column.

    The seasons are a written table of one row each, joined by their key: a broadcast while it is small,
    as for calendar parts, and a shuffled join for keys of any other kind.
    """

    by: str
    cols: Sequence[str]
    seasons: DataFrame | None
    overall: Mapping[str, float]
    zero_is_missing: bool

    def _base(self, df: DataFrame) -> DataFrame:
        def clean(c):
            value = F.col(c).cast("double")
            return (zero_to_null(value) if self.zero_is_missing else value).alias(c)

        return df.select([clean(c) if c in self.cols else F.col(c) for c in df.columns])

    def fill_seasons(self, df: DataFrame) -> DataFrame:
        """The first step alone: seasonal values only."""
        base = self._base(df)
        if self.seasons is None:
            return base
        values = self.seasons.select(F.col(self.by), *[F.col(c).alias(f"__s_{c}") for c in self.cols])
        joined = base.join(small_side(values), self.by, "left")
        return joined.select([F.coalesce(F.col(c), F.col(f"__s_{c}")).alias(c) if c in self.cols else F.col(c) for c in base.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        filled = self.fill_seasons(df)
        return filled.select([F.coalesce(F.col(c), F.lit(self.overall[c])).alias(c) if self.overall.get(c) is not None
                              else F.col(c) for c in filled.columns])


def fit_seasonal_imputer(df: DataFrame, cols: Sequence[str], by: str = "month", stat: str | Mapping[str, str] = "median",
                         zero_is_missing: bool = True, fit_filter: Column | None = None,
                         monthly: bool = False) -> SeasonalImputer:
    """Learn the fill values: the statistic of each season, then that of the seasonally filled column.

    ``stat`` is ``median`` or ``mean`` for all columns, or one of them for each. ``fit_filter`` limits the rows the
    statistics are taken from (all rows by default, hold-out included). ``monthly`` says that the table has one row
    per month. The overall statistic takes a second pass, made only for columns in which some season has no value.
    """
    cols = list(cols)
    kind = {c: stat if isinstance(stat, str) else stat[c] for c in cols}

    def statistics(rows, keys, cols):
        means = [F.avg(c).alias(c) for c in cols if kind[c] != "median"]
        medians = [c for c in cols if kind[c] == "median"]
        if monthly or not medians:
            return rows.groupBy(*keys).agg(*means, *[F.median(c).alias(c) for c in medians])
        middle = _wide_medians(rows, keys, medians, "", monthly)
        if not means:
            return middle
        side = rows.groupBy(*keys).agg(*means)
        if not keys:
            return middle.crossJoin(side)  # one row each
        pairs = side.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in cols if kind[c] != "median"])
        match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return middle.join(pairs, match, "full").select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], *cols)

    blank = SeasonalImputer(by, cols, None, {}, zero_is_missing)
    fit = df.filter(fit_filter) if fit_filter is not None else df
    rows = cut_lineage(statistics(blank._base(fit), [by], cols))
    first = SeasonalImputer(by, cols, rows.filter(F.col(by).isNotNull()), {}, zero_is_missing)

    # A season without a value, a missing season or one outside the fitted rows needs the overall value.
    gaps = rows.agg(F.coalesce(F.bool_or(F.col(by).isNull()), F.lit(True)).alias("__any"), *[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(True)).alias(c) for c in cols]).first()
    needed = [c for c in cols if fit_filter is not None or gaps["__any"] or gaps[c]]
    overall = statistics(first.fill_seasons(fit), [], needed).first().asDict() if needed else {}
    return SeasonalImputer(by, cols, first.seasons, overall, zero_is_missing)


def impute_seasonal(df: DataFrame, cols: Sequence[str], by: str = "month", stat: str | Mapping[str, str] = "median",
                    zero_is_missing: bool = True, fit_filter: Column | None = None, monthly: bool = False) -> DataFrame:
    """Fit a seasonal imputer on ``df`` and apply it; see :func:`fit_seasonal_imputer`."""
    return fit_seasonal_imputer(df, cols, by, stat, zero_is_missing, fit_filter, monthly).transform(df)


def climatology(df: DataFrame, cols: Sequence[str], by: str = "month") -> DataFrame:
    """Mean of each column per calendar part."""
    return df.dropna(subset=[by]).groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def attach_climatology(spine: DataFrame, history: DataFrame, cols: Sequence[str], by: str = "month") -> DataFrame:
    """Future rows with the seasonal means of the history, joined by calendar part or by another, measured, key."""
    means = climatology(history, cols, by)
    return spine.join(calendar_side(means) if by in CALENDAR_PARTS else measured_side(means), by, "left")


def jitter(df: DataFrame, history: DataFrame, cols: Sequence[str], key: Column, share: float = 0.05,
           seed: int = 42) -> DataFrame:
    """Gaussian variation of ``share`` of each column's standard deviation, floored at zero.

    The noise is keyed by seed, column and ``key``.
    """
    spread = history.agg(*[F.stddev_samp(c).alias(c) for c in cols]).select(F.struct(*cols).alias("s")).scalar()

    def noisy(c):
        z = keyed_normal(F.lit(str(seed)), F.lit(c), key)
        return clip(F.col(c) + z * F.col("__std")[c] * share, low=0.0)

    return df.withColumn("__std", spread).select([noisy(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, col: str, levels: Mapping[object, str]) -> DataFrame:
    """One 0/1 column per declared level, all levels kept."""
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(n) for v, n in levels.items()])


@dataclass
class LevelDictionary:
    """Levels of a category, most frequent first and then by name, with one more for what was not seen."""

    column: str
    levels: list[str]
    left_out: int

    def vector(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with a sparse 0/1 vector: one place for each level, the last for unseen, left out or missing ones."""
        indexer = StringIndexerModel.from_labels(self.levels or [""], inputCol="__level", outputCol="__index", handleInvalid="keep")
        known = indexer.transform(df.withColumn("__level", F.col(self.column).cast("string")))
        # The number of levels is in the index column's metadata: fitting reads no rows.
        encoder = OneHotEncoder(inputCol="__index", outputCol=name, dropLast=False).fit(known)
        return encoder.transform(known).drop("__level", "__index")

    def columns(self, df: DataFrame, prefix: str) -> DataFrame:
        """``df`` with one 0/1 column for each level and ``<prefix>other`` for all else."""
        own = F.col(self.column).cast("string")
        marks = [F.coalesce((own == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in self.levels]
        return df.select("*", *marks, (~F.coalesce(own.isin(self.levels), F.lit(False))).cast("int").alias(f"{prefix}other"))


def learn_levels(df: DataFrame, col: str, limit: int = 1000) -> LevelDictionary:
    """The ``limit`` most frequent levels of a column as text, ties by name; ``left_out`` tells how many there are besides.

    Counted in one grouped aggregate; at most ``limit`` names reach the driver.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    levels = [r["level"] for r in counts.orderBy(F.desc("n"), "level").limit(limit).collect()]
    return LevelDictionary(col, levels, counts.count() - len(levels))
