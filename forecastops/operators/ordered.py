"""Order-dependent operators that never need a whole group in one task.

A *slice* is a stretch of the order, small enough for one task: either a calendar slice the caller names
(such as the day of a timestamp) or a range partition. Work is done inside slices, and what has to pass
from one slice to the next travels through a table with one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastops.session import cut_lineage

CHUNK_ROWS = 8192


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "__slice") -> DataFrame:
    """Range-partition by ``keys`` and ``order`` and number the ranges.

    Sampling balances the ranges, so a hot key is spread over many of them. The layout is written
    out: later steps read it more than once and must see the same numbers, also after an executor is lost.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id())
    return cut_lineage(ranged)


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None) -> DataFrame:
    if slice_by is None:
        return range_slices(df, keys, order)
    return df.withColumn("__slice", slice_by)


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None = None,
                   name: str = "position") -> DataFrame:
    """Dense 0-based position of every row in the order of its group.

    ``order`` must be total. Rows with a missing key are left out. ``slice_by`` must not decrease along
    the order; without it range slices are used.
    """
    keys = list(keys)
    rows = _sliced(df.dropna(subset=keys) if keys else df, keys, order, slice_by)
    sizes = rows.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__size"))
    along = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__slice", F.coalesce(F.sum("__size").over(along), F.lit(0)).alias("__start"))
    local = Window.partitionBy(*keys, "__slice").orderBy(*order)
    return (rows.withColumn("__rn", F.row_number().over(local))
            .join(starts, [*keys, "__slice"])
            .withColumn(name, F.col("__start") + F.col("__rn") - 1)
            .drop("__slice", "__rn", "__start"))


def lag_features(df: DataFrame, keys: Sequence[str], ts: str, value: str, lags: Sequence[int] = (1, 24),
                 window: int = 24, slice_by: Column | None = None, trim_warmup: bool = True,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Lagged values and a trailing mean by row within each group.

    Adds ``lag_<n>h`` per lag and ``rolling_mean_<window>h``, which stays missing until the window holds
    ``window`` values. Lags count rows, gaps in time are not filled. Groups are cut into chunks of
    ``chunk_rows`` rows; each chunk also receives the few rows before it that its first rows look back on.
    ``trim_warmup`` drops the rows where any added column is missing.
    """
    keys = list(keys)
    reach = max([*lags, window - 1])
    if chunk_rows < reach:
        raise ValueError("chunk_rows must cover the longest look-back")
    placed = with_positions(df, keys, [ts], slice_by, "__pos")
    home = F.floor(F.col("__pos") / chunk_rows)
    feeds_next = F.col("__pos") % chunk_rows >= chunk_rows - reach
    chunks = F.when(feeds_next, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.withColumn("__home", home).withColumn("__chunk", F.explode(chunks))

    w = Window.partitionBy(*keys, "__chunk").orderBy("__pos")
    trailing = w.rowsBetween(-(window - 1), 0)
    mean = F.when(F.count(value).over(trailing) == window, F.avg(value).over(trailing))
    added = {f"lag_{n}h": F.lag(value, n).over(w) for n in lags} | {f"rolling_mean_{window}h": mean}
    out = spread.select("*", *[c.alias(n) for n, c in added.items()])
    out = out.filter(F.col("__home") == F.col("__chunk")).drop("__pos", "__home", "__chunk")
    return out.dropna(subset=list(added)) if trim_warmup else out


def interpolate_linear(df: DataFrame, order: Sequence[str], cols: Sequence[str], keys: Sequence[str] = (),
                       slice_by: Column | None = None) -> DataFrame:
    """Fill gaps on the straight line between neighbours, by row position.

    Leading gaps stay missing, trailing gaps repeat the last value. Without ``keys`` the whole table is
    one series. ``order`` must be total. All columns are filled in one pass over one layout.
    """
    keys = list(keys)
    rows = _sliced(df, keys, order, slice_by)
    local = Window.partitionBy(*keys, "__slice")
    rows = rows.withColumn("__rn", F.row_number().over(local.orderBy(*order)))

    def known(c, pos):
        return F.when(F.col(c).isNotNull(), F.struct(pos.alias("pos"), F.col(c).cast("double").alias("val")))

    here = F.col("__rn").cast("bigint")
    ends = rows.groupBy(*keys, "__slice").agg(
        F.count(F.lit(1)).alias("__size"),
        *[F.min(known(c, here)).alias(f"__first_{c}") for c in cols],
        *[F.max(known(c, here)).alias(f"__last_{c}") for c in cols])

    # One row per slice: shift local positions to positions in the series, carry neighbours across.
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))

    def shifted(c):
        return F.when(c.isNotNull(), F.struct((c["pos"] + F.col("__start")).alias("pos"), c["val"].alias("val")))

    carry = ends.select(
        *keys, "__slice", "__start",
        *[F.last(shifted(F.col(f"__last_{c}")), ignorenulls=True).over(before).alias(f"__prev_{c}") for c in cols],
        *[F.last(shifted(F.col(f"__first_{c}")), ignorenulls=True).over(after).alias(f"__next_{c}") for c in cols])

    joined = rows.join(carry, [*keys, "__slice"], "left") if not keys else _null_safe(rows, carry, [*keys, "__slice"])
    joined = joined.withColumn("__pos", F.col("__start") + F.col("__rn"))
    up = local.orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    down = local.orderBy(F.desc("__rn")).rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col("__pos")
    joined = joined.select(
        "*",
        *[F.coalesce(F.last(known(c, pos), ignorenulls=True).over(up), F.col(f"__prev_{c}")).alias(f"__l_{c}")
          for c in cols])
    joined = joined.select(
        "*",
        *[F.coalesce(F.last(known(c, pos), ignorenulls=True).over(down), F.col(f"__next_{c}")).alias(f"__r_{c}")
          for c in cols])

    def filled(c):
        left, right = F.col(f"__l_{c}"), F.col(f"__r_{c}")
        slope = F.try_divide(right["val"] - left["val"], (right["pos"] - left["pos"]).cast("double"))
        line = left["val"] + slope * (pos - left["pos"])
        return (F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
                .when(right.isNull(), left["val"]).otherwise(line))

    return joined.select([filled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _null_safe(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join where a missing key meets a missing key."""
    renamed = other.select([F.col(c).alias(f"__o_{c}") if c in keys else F.col(c) for c in other.columns])
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__o_{k}"))
        condition = same if condition is None else condition & same
    return rows.join(renamed, condition, "left").drop(*[f"__o_{k}" for k in keys])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group. Spark limits each map task to ``k`` rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return top_k(df, by, order, 1)
