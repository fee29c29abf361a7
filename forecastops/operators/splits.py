"""Train and test splits: by year, by time, by hash, by label, and expanding folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastops.functions import hash_number
from forecastops.operators.joins import measured_side

HASH_SLICE = 2**16


def split_at_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
                  n_first: Callable[[Column], Column] | None = None, quota: DataFrame | None = None,
                  name: str = "is_first") -> DataFrame:
    """Mark the first ``n`` rows of each group in a total order.

    ``n`` is ``n_first(group size)``, or comes from ``quota`` (``keys`` and ``__target``). Instead of
    ranking all rows the border row of each group is found: counts per slice tell the slice it lies in,
    only that slice is ranked, and every row is then compared with the border, without a shuffle when the
    groups are few. ``slice_by`` must not decrease along the order.
    """
    keys = list(keys)
    rows = df.withColumn("__slice", slice_by)
    sizes = rows.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__size"))
    group = Window.partitionBy(*keys)
    sizes = (sizes.withColumn("__cum", F.sum("__size").over(
                group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("__total", F.sum("__size").over(group)))
    if quota is None:
        sizes = sizes.withColumn("__target", n_first(F.col("__total")))
    else:
        sizes = sizes.join(quota, keys)
    before = F.col("__cum") - F.col("__size")
    border_slice = (sizes.filter((F.col("__target") > before) & (F.col("__target") <= F.col("__cum")))
                    .select(*keys, "__slice", (F.col("__target") - before).alias("__nth")))
    ranked = rows.select(*keys, "__slice", F.struct(*order).alias("__border")).join(border_slice, [*keys, "__slice"])
    ranked = ranked.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy("__border")))
    border = measured_side(ranked.filter(F.col("__rn") == F.col("__nth")).select(*keys, "__border"))
    marked = df.join(border, keys, "left") if keys else df.withColumn("__border", border.select("__border").scalar())
    return marked.withColumn(name, F.coalesce(F.struct(*order) <= F.col("__border"), F.lit(False))).drop("__border")


def split_chronological(df: DataFrame, keys: Sequence[str], ts: str, slice_by: Column, test_share: float = 0.2,
                        name: str = "split") -> DataFrame:
    """``train`` for the first rows of each group in time, ``valid`` for the last ``ceil(share * n)``."""
    def n_train(n):
        return n - F.ceil(n * F.lit(test_share))

    out = split_at_rank(df, keys, [ts], slice_by, n_train, name="__train")
    return out.withColumn(name, F.when(F.col("__train"), "train").otherwise("valid")).drop("__train")


def split_random(df: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """Exactly ``ceil(share * n)`` test rows: the last ones in the order of a hash of the row key."""
    key = list(key)
    rows = df.withColumn("__h", hash_number(F.lit(str(seed)), *[F.col(k) for k in key]))
    out = split_at_rank(rows, [], ["__h", *key], F.floor(F.col("__h") / HASH_SLICE), lambda n: n - F.ceil(n * F.lit(test_share)), name="__train")
    return out.withColumn(name, F.when(F.col("__train"), "train").otherwise("test")).drop("__train", "__h")


def split_stratified(df: DataFrame, label: str, key: Sequence[str], test_share: float = 0.2, seed: int = 42,
                     name: str = "split") -> DataFrame:
    """Exactly ``ceil(share * n)`` test rows, spread over the labels in proportion.

    Each label gives the whole part of its share to training, and the rows left over go to the labels
    with the largest remainders. Inside a label rows are taken by the hash of ``key``, whose leading bits
    also slice a label evenly, so the border row is found without gathering a label.
    """
    key = list(key)
    rows = df.withColumn("__h", hash_number(F.lit(str(seed)), *[F.col(k) for k in key]))
    # One row per class; the number of classes is fixed by the problem.
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy()
    n_all = F.sum("__n").over(everything)
    n_train = n_all - F.ceil(n_all * F.lit(test_share))
    quota = classes.select(label, "__n", n_train.alias("__n_train"), (F.col("__n") * n_train / n_all).alias("__share"))
    quota = quota.withColumn("__base", F.floor("__share"))
    left_over = F.col("__n_train") - F.sum("__base").over(everything)
    by_remainder = everything.orderBy(F.desc(F.col("__share") - F.col("__base")), F.col(label))
    quota = quota.select(label, (F.col("__base") + F.when(F.row_number().over(by_remainder) <= left_over, 1)
                                 .otherwise(0)).alias("__target"))
    out = split_at_rank(rows, [label], ["__h", *key], F.floor(F.col("__h") / HASH_SLICE), quota=quota, name="__train")
    return out.withColumn(name, F.when(F.col("__train"), "train").otherwise("test")).drop("__train", "__h")


def expanding_folds(df: DataFrame, keys: Sequence[str], n_splits: int) -> DataFrame:
    """Row ranges of an expanding-window cross-validation, one row per group and fold.

    The last ``n_splits`` blocks of ``n div (n_splits + 1)`` rows are the test blocks; each fold trains on
    all rows before its block. Ends are exclusive.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    size = F.floor(F.col("n") / (n_splits + 1))
    out = sizes.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    start = F.col("n") - (F.lit(n_splits + 1) - F.col("fold")) * size
    return out.select(*keys, "fold", "n", F.lit(0).cast("bigint").alias("train_start"), start.alias("train_end"),
                      start.alias("test_start"), (start + size).alias("test_end"))
