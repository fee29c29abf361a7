"""Exact quantiles with linear interpolation, also for groups too large for one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecastops.operators.joins import measured_side

BUCKETS_PER_OCTAVE = 1024
CELLS_PER_BUCKET = 65536
LOWEST_OCTAVE = 1100  # no double lies below 2 ** -1074


def _buckets_and_cells(v):
    """Two order-preserving codes of a number: a bucket, and a cell inside the bucket.

    Numbers within about 0.07 % of each other share a bucket, and a number has at most some four million
    buckets; numbers within about 1e-8 of each other, relatively, share a cell. Both follow the number's
    logarithm at every magnitude, so tiny values spread like large ones; only zero has a bucket of its own.
    """
    depth = (F.log2(F.abs(v)) + LOWEST_OCTAVE) * BUCKETS_PER_OCTAVE
    bucket, cell = F.floor(depth), F.floor((depth - F.floor(depth)) * CELLS_PER_BUCKET)
    sign = F.when(v < 0, -1).otherwise(1)
    zero = v == 0
    return F.when(zero, 0).otherwise(bucket * sign), F.when(zero, 0).otherwise(cell * sign)


def _narrow(counts: DataFrame, within: Sequence[str], code: str, carried: Sequence[str]) -> DataFrame:
    """One row per ``within`` and ``code`` with the count of rows up to and before it."""
    sizes = counts.groupBy(*within, code).agg(F.sum("__n").alias("__n"), *[F.first(c).alias(c) for c in carried])
    order = Window.partitionBy(*within).orderBy(code).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("__cum", F.sum("__n").over(order)).withColumn("__start", F.col("__cum") - F.col("__n"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per group of ``by`` with the quantiles named in ``probs``; missing values are skipped.

    The built-in exact percentile gathers all distinct values of a group in one buffer. Here rows are
    first counted per distinct value, which spreads a hot group over the cluster. Counts per bucket tell
    which bucket holds each wanted rank, counts per cell of those buckets tell the cell, and only the
    values of those cells are put in order. Every step works on counts; a task holds at most the bucket
    codes of a group, the cell codes of a bucket or the values of a cell.
    """
    by = list(by)
    # The codes are grouping keys and filtered up front, so that all readers below share one shuffle.
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    bucket, cell = _buckets_and_cells(F.col("__v"))
    rows = rows.withColumns({"__b": bucket, "__c": cell}).filter(F.col("__b").isNotNull() & F.col("__c").isNotNull())
    counts = rows.groupBy(*by, "__v", "__b", "__c").agg(F.count(F.lit(1)).alias("__n"))

    # A NULL group key must meet itself when counts and ranks are joined.
    keys = [f"__k{i}" for i in range(len(by))]
    counts = counts.select("*", *[F.struct(F.col(c)).alias(k) for c, k in zip(by, keys)])

    def rank(p):
        return F.lit(float(p)) * (F.col("__total") - 1)

    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(rank(p)).alias("lo"), F.ceil(rank(p)).alias("hi"),
                                (rank(p) - F.floor(rank(p))).alias("frac")) for name, p in probs.items()])

    def holding_a_rank(stretches, on):
        def inside(edge):
            return (edge >= F.col("__start")) & (edge < F.col("__cum"))

        hits = stretches.withColumn("__wanted", F.filter("__wanted", lambda w: inside(w["lo"]) | inside(w["hi"])))
        return hits.filter(F.size("__wanted") > 0).select(*on, F.col("__start").alias("__before"), "__wanted")

    buckets = _narrow(counts, keys, "__b", [])
    buckets = buckets.withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys))).withColumn("__wanted", wanted)
    in_bucket = [*keys, "__b"]
    cells = _narrow(counts.join(holding_a_rank(buckets, in_bucket), in_bucket), in_bucket, "__c", ["__before", "__wanted"])
    cells = cells.withColumns({"__start": F.col("__start") + F.col("__before"), "__cum": F.col("__cum") + F.col("__before")})
    in_cell = [*in_bucket, "__c"]
    values = counts.join(holding_a_rank(cells, in_cell), in_cell)
    order = Window.partitionBy(*in_cell).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    values = (values.withColumn("__cum", F.col("__before") + F.sum("__n").over(order))
              .withColumn("__start", F.col("__cum") - F.col("__n"))
              .withColumn("__w", F.explode("__wanted")))

    def edge_value(name, edge):
        here = (F.col(f"__w.{edge}") >= F.col("__start")) & (F.col(f"__w.{edge}") < F.col("__cum"))
        return F.max(F.when(here & (F.col("__w.name") == name), F.col("__v")))

    def share(name):
        return F.max(F.when(F.col("__w.name") == name, F.col("__w.frac")))

    return values.groupBy(*by).agg(*[
        (edge_value(n, "lo") + (edge_value(n, "hi") - edge_value(n, "lo")) * share(n)).alias(n) for n in probs])


def small_group_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Same result through the built-in percentile, for groups whose size the calendar bounds."""
    names = list(probs)
    exact = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs.values()]))
    return (df.groupBy(*by).agg(exact.alias("__q"))
            .select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)]))


def iqr_filter(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Rows inside ``[q1 - reach * iqr, q3 + reach * iqr]`` of their group.

    The fences have one row per group. They are written out once and counted; when there are few, the
    rows are filtered where they are, without a shuffle.
    """
    fences = measured_side(exact_quantiles(df, by, value, {"__q1": 0.25, "__q3": 0.75}))
    iqr = F.col("__q3") - F.col("__q1")
    inside = F.col(value).between(F.col("__q1") - reach * iqr, F.col("__q3") + reach * iqr)
    return df.join(fences, list(by)).filter(inside).drop("__q1", "__q3")
