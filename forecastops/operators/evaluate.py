"""Hold-out evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forecast_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and MAPE (in %) per series; rows without actual or prediction are left out, and a zero
    actual has no percentage error."""
    error = F.col(actual) - F.col(predicted)
    return (df.dropna(subset=[actual, predicted]).groupBy(*by)
            .agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
                 (F.avg(F.abs(F.try_divide(error, F.col(actual)))) * 100).alias("mape")))


def actual_vs_predicted(df: DataFrame, ids: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide actual and predicted columns to ``series, actual, predicted`` rows, one per series."""
    rows = [F.struct(F.lit(name).alias("series"), F.col(a).cast("double").alias("actual"),
                     F.col(p).cast("double").alias("predicted")) for name, (a, p) in pairs.items()]
    return df.select(*ids, F.explode(F.array(*rows)).alias("r")).select(*ids, "r.series", "r.actual", "r.predicted")


def seasonal_naive(df: DataFrame, keys: Sequence[str], month_start: str, value: str, name: str = "predicted") -> DataFrame:
    """The value of the same month one year earlier as the prediction."""
    past = df.select(*keys, F.add_months(month_start, 12).alias(month_start), F.col(value).alias(name))
    return df.join(past, [*keys, month_start], "left")


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    The data is reduced to counts per (label, prediction) pair first; all that follows is as small as the
    number of classes squared. A ratio with nothing to divide by is zero.
    """
    pairs = df.groupBy(F.col(label).cast("string").alias("l"), F.col(prediction).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                 F.col("n").alias("real"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("real"),
                 F.col("n").alias("said")))).alias("r")).select("r.*")
    per_class = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hit", "real", "said")])

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    per_class = per_class.select("class", ratio(F.col("hit"), F.col("said")).alias("precision"),
                                 ratio(F.col("hit"), F.col("real")).alias("recall"), "hit", "real")
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    per_class = per_class.withColumn("f1_score", f1)
    scores = ["precision", "recall", "f1_score"]

    totals = per_class.agg(
        F.sum("hit").alias("hit"), F.sum("real").alias("real"), *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[ratio(F.sum(F.col(s) * F.col("real")), F.sum("real")).alias(f"weighted_{s}") for s in scores])
    accuracy = ratio(F.col("hit"), F.col("real"))
    support = F.col("real").cast("double")

    def row(name, values, n):
        return F.struct(F.lit(name).alias("class"), *[v.alias(s) for v, s in zip(values, scores)], n.alias("support"))

    summary = totals.select(F.explode(F.array(
        row("accuracy", [accuracy] * 3, accuracy),
        row("macro avg", [F.col(f"macro_{s}") for s in scores], support),
        row("weighted avg", [F.col(f"weighted_{s}") for s in scores], support))).alias("r")).select("r.*")
    return per_class.select("class", *scores, support.alias("support")).unionByName(summary)
