"""Forecasting: linear regression, boosted trees, cross-validation and post-processing."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecastops.functions import clip, keyed_normal, nan_to_null
from forecastops.operators.joins import small_side
from forecastops.operators.quantiles import small_group_quantiles
from forecastops.session import cut_lineage, path_exists, scratch_path

MISSING_LEVEL = -1.0e9  # below every real value: trees send missing weather to the low side
PARALLEL_FITS = 4


@dataclass(frozen=True)
class BoostParams:
    """Settings of a boosted regression, named as in common tree libraries."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 4
    subsample: float = 0.8
    colsample: float = 0.8
    seed: int = 42

    def estimator(self, features: str, label: str, prediction: str) -> GBTRegressor:
        return GBTRegressor(
            maxIter=self.n_estimators, stepSize=self.learning_rate, maxDepth=self.max_depth,
            subsamplingRate=self.subsample, featureSubsetStrategy="all" if self.colsample >= 1 else str(self.colsample),
            seed=self.seed, featuresCol=features, labelCol=label, predictionCol=prediction)


def param_grid(**choices: Sequence) -> list[BoostParams]:
    """All combinations of the listed settings."""
    combos: list[dict] = [{}]
    for name, values in choices.items():
        combos = [{**c, name: v} for c in combos for v in values]
    return [BoostParams(**c) for c in combos]


@dataclass
class LinearFit:
    """A fitted linear model over numeric features and, if asked for, one effect for each level of a category."""

    names: list[str]
    coefficients: list[float]
    intercept: float
    score: Callable[[DataFrame, str], DataFrame]
    category: str | None = None
    effects: DataFrame | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        """``part, feature, coefficient`` rows: numeric features, then the levels, each part largest first."""
        rows = spark.createDataFrame(list(zip(self.names, self.coefficients)), "feature string, coefficient double")
        rows = rows.select(F.lit("numeric").alias("part"), "feature", "coefficient")
        if self.effects is not None:
            level = F.concat(F.lit(f"{self.category}_"), F.col(self.category).cast("string")).alias("feature")
            rows = rows.unionByName(self.effects.select(F.lit("level").alias("part"), level, F.col("__effect").alias("coefficient")))
        return rows.orderBy(F.desc("part"), F.desc("coefficient"))


def fit_linear(train: DataFrame, features: Sequence[str], label: str, category: str | None = None, solver: str = "normal") -> LinearFit:
    """Least squares without penalty; every level of ``category`` has its own effect, and the effects sum to zero.

    The category is absorbed: features and label are centred within each level by one grouped aggregate, the
    numeric features alone are fitted, and a level's effect is what is left of its mean. That equals the fit with
    one column for each level, at any number of levels. Rows with a missing feature cannot be fitted and are left
    out; an unseen level is scored without an effect.
    """
    inputs = list(features)
    rows = train.dropna(subset=[*inputs, label] + ([category] if category else []))
    rows = rows.select(*([category] if category else []), *[F.col(c).cast("double").alias(c) for c in [*inputs, label]])
    means = None
    if category:
        means = cut_lineage(rows.groupBy(category).agg(*[F.avg(c).alias(f"__m_{c}") for c in [*inputs, label]]))
        rows = rows.join(small_side(means), category).select(*[(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in [*inputs, label]])
    assembler = VectorAssembler(inputCols=inputs, outputCol="__x", handleInvalid="keep")
    model = LinearRegression(solver=solver, regParam=0.0, fitIntercept=category is None, featuresCol="__x", labelCol=label,
                             predictionCol="__p").fit(assembler.transform(rows))
    coefficients, intercept, effects = [float(c) for c in model.coefficients], float(model.intercept), None

    def linear(prefix: str = "") -> Column:
        return sum((F.col(f"{prefix}{c}").cast("double") * w for c, w in zip(inputs, coefficients)), F.lit(0.0))

    if category:
        raw = means.select(category, (F.col(f"__m_{label}") - linear("__m_")).alias("__effect"))
        intercept = float(raw.agg(F.avg("__effect")).first()[0] or 0.0)
        effects = cut_lineage(raw.withColumn("__effect", F.col("__effect") - intercept))

    def score(df: DataFrame, name: str = "predicted") -> DataFrame:
        value = linear() + intercept
        if effects is None:
            return df.withColumn(name, value)
        joined = df.join(small_side(effects), category, "left")
        return joined.withColumn(name, value + F.coalesce("__effect", F.lit(0.0))).drop("__effect")

    return LinearFit(inputs, coefficients, intercept, score, category, effects)


def moment_table(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, sums and sums of products of features and label for each group, in one aggregate.

    Such tables add up: see :func:`add_moments`. Rows with a missing value are left out.
    """
    names = [*features, label]
    rows = df.dropna(subset=names).select(*by, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    sums = [F.sum(f"v{i}").alias(f"s{i}") for i in range(len(names))]
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def add_moments(tables: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The moments of all rows together, from those of parts: days that come later are added, not read again."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*by).agg(*[F.sum(c).alias(c) for c in out.columns if c not in by])


def solve_moments(moments: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, coefficient`` of the least-squares fit behind a moment table of one row, ``intercept`` among them.

    The equations have one row for each feature, so they are solved in one place. Features that others
    determine share their weight (least norm). Without rows there is no coefficient.
    """
    spark, k = moments.sparkSession, len(features)
    row = moments.first()
    if row is None or not row["n"]:
        return spark.createDataFrame([], "feature string, coefficient double")
    n, s = row["n"], np.array([row[f"s{i}"] for i in range(k + 1)])
    p = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    centred = p - np.outer(s, s) / n
    scale = np.sqrt(np.where(np.diag(centred)[:k] > 0, np.diag(centred)[:k], 1.0))
    weights = np.linalg.lstsq(centred[:k, :k] / np.outer(scale, scale), centred[:k, k] / scale, rcond=1e-12)[0] / scale
    rows = [*zip(features, weights.tolist()), ("intercept", float((s[k] - weights @ s[:k]) / n))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def tree_vector(df: DataFrame, features: Sequence[str], name: str = "__x") -> DataFrame:
    """Feature vector for tree models with missing values (NULL or NaN) set to one level."""
    cols = [f"__f{i}" for i in range(len(features))]
    df = df.withColumns({n: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(MISSING_LEVEL)) for n, c in zip(cols, features)})
    return VectorAssembler(inputCols=cols, outputCol=name).transform(df).drop(*cols)


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, params: BoostParams):
    """Boosted regression; returns a function that scores a table."""
    rows = tree_vector(train.dropna(subset=[label]), features).select(
        "__x", F.col(label).cast("double").alias("__y")).persist()
    try:
        model = params.estimator("__x", "__y", "__p").fit(rows)
    finally:
        rows.unpersist()

    def score(df: DataFrame, name: str = "predicted") -> DataFrame:
        return model.transform(tree_vector(df, features)).drop("__x").withColumnRenamed("__p", name)

    return score


def fit_many(train: DataFrame, features: Sequence[str], labels: Sequence[str], params: Mapping[str, BoostParams]):
    """One boosted model per label column, a few fits at a time; returns a function that adds all predictions.

    The series are the columns of a wide table, so their number is fixed by the schema. The feature
    vector is built and kept once for all fits.
    """
    # A wide monthly table is bounded by the calendar; in one partition each boosting step is one task.
    rows = tree_vector(train, features).select("__x", *[F.col(c).cast("double").alias(c) for c in labels]).coalesce(1).persist()
    try:
        def one(c):
            return params[c].estimator("__x", c, f"{c}__p").fit(rows.filter(F.col(c).isNotNull()))

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            models = dict(zip(labels, pool.map(one, labels)))
    finally:
        rows.unpersist()

    def score(df: DataFrame) -> DataFrame:
        out = tree_vector(df, features)
        for model in models.values():
            out = model.transform(out)
        return out.drop("__x")

    return score


def staged_settings(grid: Sequence[BoostParams]) -> list[list[BoostParams]]:
    """Settings that differ in their number of trees alone, together; the largest last.

    Tree ``m`` of a fit does not depend on how many follow, so the largest fit answers for all of its group.
    """
    groups: dict[BoostParams, list[BoostParams]] = {}
    for p in grid:
        groups.setdefault(replace(p, n_estimators=1), []).append(p)
    return [sorted(g, key=lambda p: p.n_estimators) for g in groups.values()]


def time_series_cv(df: DataFrame, features: Sequence[str], label: str, position: str, n_splits: int,
                   grid: Sequence[BoostParams], monthly: bool = False) -> tuple[BoostParams, list[tuple[BoostParams, int, float]]]:
    """Expanding-window search: every fold trains on rows before its test block only.

    Returns the setting with the lowest mean squared error over the folds, and the error of every fold.
    ``position`` is the dense 0-based order; rows of several series may share one. Settings that differ in their number
    of trees take one fit, scored after each tree. Folds without training or test rows are left out; where none is
    left, the first setting is returned. Scores are one number per setting and fold.
    """
    rows = tree_vector(df.dropna(subset=[label]), features).select(
        "__x", F.col(label).cast("double").alias("__y"), F.col(position).alias("__pos"))
    # A monthly table is bounded by the calendar; in one partition each boosting step is one task.
    rows = (rows.coalesce(1) if monthly else rows).persist()
    try:
        n = (rows.agg(F.max("__pos")).first()[0] or 0) + 1
        size = n // (n_splits + 1)
        starts = [n - (n_splits + 1 - i) * size for i in range(1, n_splits + 1)]

        def run(job):
            settings, fold, start = job
            train, test = rows.filter(F.col("__pos") < start), rows.filter((F.col("__pos") >= start) & (F.col("__pos") < start + size))
            if train.isEmpty() or test.isEmpty():
                return []
            model = settings[-1].estimator("__x", "__y", "__p").fit(train)
            errors = model.evaluateEachIteration(test, "squared")
            # Without anything left to learn Spark stops early; the trees there are stand for all later ones.
            return [(p, fold, float(errors[min(p.n_estimators, len(errors)) - 1])) for p in settings]

        jobs = [(g, i + 1, s) for g in staged_settings(grid) for i, s in enumerate(starts)] if size else []
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            found = {(p, fold): e for scores in pool.map(run, jobs) for p, fold, e in scores}
    finally:
        rows.unpersist()
    scores = [(p, fold, found[p, fold]) for p in grid for fold in range(1, n_splits + 1) if (p, fold) in found]

    def mean_error(p):
        errors = [s for q, _, s in scores if q == p]
        return sum(errors) / len(errors) if errors else math.inf

    return min(grid, key=mean_error), scores


def series_errors(df: DataFrame, features: Sequence[str], label: str, position: str, n_splits: int, grid: Sequence[BoostParams],
                  series: str = "series", folder: str | None = None) -> DataFrame:
    """``setting`` (place in ``grid``), ``fold``, ``series``, ``error`` and test ``rows`` of an expanding-window search over pooled series.

    One model for each setting and fold, whatever the number of series; its mean squared errors by series are written at
    once. In a ``folder`` of its own a search that was interrupted goes on where it stopped: a setting and fold whose
    table is complete is not fitted again. The folder belongs to one table of rows.
    """
    spark = df.sparkSession
    rows = tree_vector(df.dropna(subset=[label]), features).select(
        "__x", F.col(label).cast("double").alias("__y"), F.col(position).alias("__pos"), F.col(series).alias("series")).persist()
    folder = folder or scratch_path(spark, "search")
    try:
        n = (rows.agg(F.max("__pos")).first()[0] or 0) + 1
        size = n // (n_splits + 1)

        def run(job):
            params, fold = job
            start = n - (n_splits + 1 - fold) * size
            path = f"{folder}/{hashlib.md5(repr((params, fold, n_splits, n)).encode()).hexdigest()}"
            if not path_exists(spark, f"{path}/_SUCCESS"):
                train, test = rows.filter(F.col("__pos") < start), rows.filter((F.col("__pos") >= start) & (F.col("__pos") < start + size))
                if train.isEmpty() or test.isEmpty():
                    return None
                scored = params.estimator("__x", "__y", "__p").fit(train).transform(test)
                errors = scored.groupBy("series").agg(F.avg(F.pow(F.col("__y") - F.col("__p"), 2)).alias("error"), F.count(F.lit(1)).alias("rows"))
                errors.coalesce(1).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path).select(F.lit(grid.index(params)).alias("setting"), F.lit(fold).alias("fold"), "series", "error", "rows")

        jobs = [(p, fold) for p in grid for fold in range(1, n_splits + 1)] if size else []
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            tables = [t for t in pool.map(run, jobs) if t is not None]
    finally:
        rows.unpersist()
    if not tables:
        return spark.createDataFrame([], "setting int, fold int, series string, error double, rows long")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def chosen_settings(errors: DataFrame) -> DataFrame:
    """``series`` and the ``setting`` of its lowest mean error over the folds; the first of equal ones."""
    means = errors.groupBy("series", "setting").agg(F.avg("error").alias("error"))
    return means.groupBy("series").agg(F.min(F.struct("error", "setting"))["setting"].alias("setting"))


def series_bounds(long: DataFrame, series: str = "series", value: str = "value") -> DataFrame:
    """Clip bounds per series: 5 % quantile of the positive values and 95 % quantile of all.

    Series are monthly, so the calendar bounds each group.
    """
    low = small_group_quantiles(long.filter(F.col(value) > 0), [series], value, {"low": 0.05})
    high = small_group_quantiles(long, [series], value, {"high": 0.95})
    return high.join(low, series, "left")


def season_adjust(df: DataFrame, predicted: str, series: str, month_start: str, first_month: str, amplitude: float = 0.05,
                  noise: float = 0.05, scale: float = 1.1, seed: int = 42, name: str = "forecast") -> DataFrame:
    """Yearly sine wave times keyed noise, held inside the bounds ``low`` and ``high``, then scaled.

    The month counter is calendar arithmetic on the key, so no row numbers are needed.
    """
    start = F.lit(first_month).cast("date")
    months = (F.year(month_start) - F.year(start)) * 12 + F.month(month_start) - F.month(start)
    wave = 1 + amplitude * F.sin(2 * math.pi * months / 12)
    draw = 1 + noise * keyed_normal(F.lit(str(seed)), F.col(series), F.col(month_start))
    return df.withColumn(name, clip(F.col(predicted) * wave * draw, F.col("low"), F.col("high")) * scale)


def log_target(c) -> Column:
    return F.log1p(F.col(c).cast("double"))


def counts_from_log(c) -> Column:
    """Back from the log scale to whole counts, rounded half to even."""
    return F.rint(F.expm1(F.col(c))).cast("bigint")
