"""Joins.

A side is broadcast only when its size is known to be small: either the calendar bounds it (one row per
month or per hour of day) or :func:`small_side` has counted it. Everything else is left to the sort-merge
join, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.session import cut_lineage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes, ``df`` itself otherwise.

    At most ``max_rows + 1`` rows are looked at. For tables that are read as they are; a side that is computed
    would be computed twice, see :func:`measured_side`.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    width = F.lit(8 * len(df.columns)).cast("bigint")
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0))
    rows, size = df.select(width.alias("b")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("b")).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def measured_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """:func:`small_side` for a side that is costly to compute, such as one statistic per group.

    The side is written out once, so neither the count nor the join computes it again.
    """
    return small_side(cut_lineage(df), max_rows)


def spread_join(many: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``side`` on few, heavy keys such as months, without dealing ``many`` out by the key alone.

    A side of small size is broadcast. Otherwise each row of ``many`` goes to one of ``salts`` tasks of its key, by
    a hash of its values, and ``side`` is repeated for each of them.
    """
    written = cut_lineage(side)
    if is_small(written):
        return many.join(F.broadcast(written), list(keys), how)
    plain = [F.col(f"`{c}`") for c, kind in many.dtypes if not kind.startswith("map")]
    salted = many.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = written.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def calendar_side(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table with one row per month (at most 9,999 x 12) or coarser.

    Only for tables grouped by parsed calendar parts, whose size does not grow with the data.
    """
    return F.broadcast(df)


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Column names with a prefix, so that star expansions of several tables cannot collide."""
    return df.select([F.col(f"`{c}`").alias(c if c in keep else f"{prefix}{c}") for c in df.columns])


def join_derived(left: DataFrame, right: DataFrame, keys: Mapping[str, tuple[Column, Column]],
                 how: str = "left") -> DataFrame:
    """Equi join on expressions. Each key is projected once per side and appears once in the result."""
    names = list(keys)
    l_side = left.select("*", *[keys[k][0].alias(k) for k in names])
    r_side = right.select("*", *[keys[k][1].alias(k) for k in names])
    return l_side.join(r_side, names, how)


def star_join(fact: DataFrame, fact_key: Column, dimensions: Mapping[str, tuple[DataFrame, Column]],
              key: str = "__month") -> DataFrame:
    """Left joins of one fact table to several tables on one derived key, each side under its own prefix."""
    out = fact.withColumn(key, fact_key)
    for prefix, (dim, dim_key) in dimensions.items():
        out = spread_join(out, prefix_columns(dim.withColumn(key, dim_key), prefix, keep=(key,)), [key])
    return out.drop(key)


def right_join_chain(first: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """RIGHT joins that all compare with the keys of ``first``.

    Rows that an earlier step null-extended carry NULL keys and so match nothing further; each step
    keeps every row of its own right side.
    """
    out = first
    for i, other in enumerate(others):
        # A right join with the sides exchanged: every row of ``other`` stays, its keys are not kept.
        names = [c for c in other.columns if c not in keys]
        held = out.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*out.columns).alias("__out"))
        right = other.withColumnsRenamed({k: f"__k_{k}" for k in keys})
        joined = spread_join(right, held, [f"__k_{k}" for k in keys])
        out = joined.select(*[F.col(f"__out.{c}").alias(c) for c in out.columns], *names)
    return out


def spine_join(spine: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left joins of a spine to tables that hold one row per calendar key."""
    return reduce(lambda acc, t: acc.join(calendar_side(t), list(keys), "left"), tables, spine)


def join_sums(left: DataFrame, right: DataFrame, keys: Sequence[str], left_sums: Mapping[str, Column],
              right_sums: Mapping[str, Column], how: str = "inner", left_max: Mapping[str, Column] | None = None) -> DataFrame:
    """Per-key SUMs over ``left JOIN right`` without forming the joined rows.

    In a join on ``keys`` every left row of a key meets all right rows of that key, so
    ``SUM(l.x) = sum_l(x) * n_r`` and ``SUM(r.y) = sum_r(y) * n_l``. Both sides shrink to one row per key
    before the shuffle; a hot key costs one row instead of a product. ``joined_rows`` is the number of
    rows the join would have had. Integer sums are exact. ``left_max`` adds maxima of the left side.
    """
    keys, left_max = list(keys), left_max or {}
    l_side = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nl"),
                                     *[F.sum(c).alias(n) for n, c in left_sums.items()],
                                     *[F.max(c).alias(n) for n, c in left_max.items()])
    r_side = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nr"),
                                      *[F.sum(c).alias(n) for n, c in right_sums.items()])
    joined = l_side.join(r_side, keys, how)
    copies = F.coalesce(F.col("__nr"), F.lit(1))
    return joined.select(
        *keys, (F.col("__nl") * copies).alias("joined_rows"),
        *[(F.col(n) * copies).alias(n) for n in left_sums],
        *[(F.col(n) * F.col("__nl")).alias(n) for n in right_sums], *left_max)


def merge_outer(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of several tables on shared keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), tables)
