"""Writers. Output stays in as many parts as the plan has partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> str:
    """Write ``df``; with ``partition_by`` each value gets a folder that later filters prune by.

    Rows are first spread by the partition columns through a rebalance, which AQE splits when one value
    is hot and merges when values are small, so neither giant nor tiny files appear.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> str:
    """Write ``df`` over just those partitions of ``path`` that it has rows of; all others stay.

    A rerun of one month or facility gives the same table as the first run. Written with dynamic partition overwrite:
    the new files are moved in when all tasks are done.
    """
    writer = df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_all(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv", mode: str = "errorifexists") -> dict[str, str]:
    """Export several result tables, one sub-folder each."""
    return {name: write_table(df, f"{folder}/{name}", fmt, mode=mode) for name, df in tables.items()}
