"""Pseudo-random values keyed by row content.

The value depends on the key alone, never on how rows are spread over partitions, so a retried task
reproduces it and a different cluster size gives the same data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["hash_number", "hash_share", "hash_uniform", "keyed_normal"]

HASH_STATES = 2**32


def _key(*parts) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in columns])


def hash_number(*parts) -> Column:
    """Whole number in ``[0, 2**32)`` from the first eight hex digits of the key's MD5."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform in ``(0, 1)``, both ends excluded."""
    return (hash_number(*parts) + 0.5) / float(HASH_STATES)


def hash_share(percent: int, *parts) -> Column:
    """True for about ``percent`` % of keys."""
    return hash_number(*parts) % 100 < percent


def keyed_normal(*parts) -> Column:
    """Standard normal by the Box-Muller transform of two keyed uniforms."""
    u1, u2 = hash_uniform(*parts, "a"), hash_uniform(*parts, "b")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
