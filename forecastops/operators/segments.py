"""Segmentation and classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastops.functions import row_total
from forecastops.operators.aggregates import mean_by
from forecastops.operators.forecast import PARALLEL_FITS, tree_vector
from forecastops.operators.quantiles import exact_quantiles, small_group_quantiles

LEVELS = ("Free", "Moderate", "Peak")


def standardise(df: DataFrame, cols: Sequence[str], suffix: str = "_z", population: bool = True) -> DataFrame:
    """Add z-scores; a column without spread gets zero."""
    std = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[std(c).alias(f"s_{c}") for c in cols])
    one = stats.select(F.struct("*").alias("s")).scalar()

    def z(c):
        centred = F.col(c) - F.col("__z")[f"m_{c}"]
        spread = F.col("__z")[f"s_{c}"]
        return F.when(spread == 0, centred).otherwise(centred / spread)

    return df.withColumn("__z", one).select(*df.columns, *[z(c).alias(f"{c}{suffix}") for c in cols])


def nearest_centre(cols: Sequence[str | Column], centres: Sequence[Sequence[float]], labels: Sequence) -> Column:
    """Label of the closest of a few centres, as a column expression; NULL when a coordinate is missing."""
    columns = [F.col(c) if isinstance(c, str) else c for c in cols]

    def distance(centre):
        total = F.lit(0.0)
        for c, x in zip(columns, centre):
            total = total + (c - F.lit(float(x))) * (c - F.lit(float(x)))
        return total

    ranked = [F.struct(distance(p).alias("d"), F.lit(i).alias("i"), F.lit(labels[i]).alias("label"))
              for i, p in enumerate(centres)]
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return F.when(known, F.array_min(F.array(*ranked))["label"])


def fit_kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, seeds: Sequence[int] = (42,)) -> list[list[float]]:
    """Centres of the best of several k-means runs, in order of their coordinates.

    Equal points are first merged into one weighted point. The objective is the same, and data on a grid
    (counts by hour) shrinks to the size of the grid before the iterations start.
    """
    points = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("__w"))
    points = VectorAssembler(inputCols=list(cols), outputCol="__x").transform(points).select("__x", "__w").persist()
    try:
        def run(seed):
            return KMeans(k=k, seed=seed, featuresCol="__x", weightCol="__w").fit(points)

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            models = list(pool.map(run, seeds))
        best = min(models, key=lambda m: m.summary.trainingCost)
        return sorted([list(map(float, c)) for c in best.clusterCenters()])
    finally:
        points.unpersist()


def cluster_series(df: DataFrame, cols: Sequence[str], k: int = 3, seeds: Sequence[int] = (42,),
                   name: str = "cluster") -> DataFrame:
    """Label rows by k-means on standardised columns. Labels stay in the table; nothing is joined back."""
    scaled = standardise(df, cols)
    z = [f"{c}_z" for c in cols]
    centres = fit_kmeans(scaled, z, k, seeds)
    return scaled.withColumn(name, nearest_centre(z, centres, list(range(len(centres)))))


def traffic_level(df: DataFrame, value: str = "total_vehicles", hour: str = "hour", seeds: Sequence[int] = range(10),
                  name: str = "traffic_level") -> DataFrame:
    """Three levels by k-means on standardised volume and hour.

    Cluster numbers carry no order, so levels are named by the volume of their centre. Rows without
    volume or hour stay unlabelled.
    """
    scaled = standardise(df.withColumns({"__v": F.col(value).cast("double"), "__h": F.col(hour).cast("double")}),
                         ["__v", "__h"], population=False)
    centres = fit_kmeans(scaled, ["__v_z", "__h_z"], len(LEVELS), list(seeds))
    label = nearest_centre(["__v_z", "__h_z"], centres, LEVELS[:len(centres)])
    return scaled.withColumn(name, label).drop("__v", "__h", "__v_z", "__h_z")


def day_type_profile(df: DataFrame, value: str = "total_vehicles") -> DataFrame:
    """Mean volume per facility, day type and hour."""
    return mean_by(df, ["facility", "day_type", "hour"], value)


def tercile_tiers(profile: DataFrame, by: Sequence[str], value: str, name: str = "traffic_level") -> DataFrame:
    """Free, Moderate or Peak by the thirds of a group; groups with fewer than three distinct values are
    left out. Groups are hour profiles of at most 24 rows, so one window per group is bounded."""
    w = Window.partitionBy(*by)
    cuts = F.percentile(F.col(value).cast("double"), F.array(F.lit(1 / 3), F.lit(2 / 3))).over(w)
    out = profile.select("*", cuts.alias("__cut"), F.size(F.collect_set(value).over(w)).alias("__kinds"))
    low, mid, high = LEVELS
    tier = F.when(F.col(value) <= F.col("__cut")[0], low).when(F.col(value) <= F.col("__cut")[1], mid).otherwise(high)
    return out.filter(F.col("__kinds") >= 3).withColumn(name, tier).drop("__cut", "__kinds")


def high_traffic(df: DataFrame, cols: Sequence[str], share: float = 0.75, total: str = "total_passengers",
                 name: str = "high_traffic", monthly: bool = False) -> DataFrame:
    """1 where the row total reaches the ``share`` quantile of all totals.

    ``monthly`` says that the table has one row per month, so its totals fit one task.
    """
    out = df.withColumn(total, row_total(cols))
    quantiles = small_group_quantiles if monthly else exact_quantiles
    limit = quantiles(out, [], total, {"q": share}).scalar()
    return out.withColumn(name, (F.col(total) >= limit).cast("int"))


def fit_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42):
    """Random forest on ``features``; returns a function that scores a table.

    Rows with missing features are fitted and scored too, as those of boosted trees: a column may have no value at all.
    """
    rows = tree_vector(train, features).select("__x", F.col(label).cast("double").alias("__y")).persist()
    try:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="__x", labelCol="__y",
                                       predictionCol="__p").fit(rows)
    finally:
        rows.unpersist()

    def score(df: DataFrame, name: str = "prediction") -> DataFrame:
        scored = model.transform(tree_vector(df, features))
        return scored.withColumn(name, F.col("__p").cast("int")).drop(
            "__x", "__p", model.getRawPredictionCol(), model.getProbabilityCol())

    return score


def code_labels(c: str, labels: Mapping[object, str]) -> Column:
    """Codes to labels; unknown codes become NULL."""
    out = None
    for code, label in labels.items():
        out = (F if out is None else out).when(F.col(c) == code, label)
    return out


def strip_prefix(c: str, prefix: str) -> Column:
    """Text without ``prefix`` where it begins with it, however long it is."""
    return F.when(F.startswith(F.col(c), F.lit(prefix)), F.substr(F.col(c), F.lit(len(prefix) + 1))).otherwise(F.col(c))
