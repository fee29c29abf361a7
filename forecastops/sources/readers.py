"""File readers. Schemas are declared; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecastops.functions import nan_to_null


def text_schema(names: Sequence[str]) -> T.StructType:
    """All columns as text, for raw files whose cells need safe casts."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header line whose columns come in the declared order; ``read_csv_by_name`` finds them by name."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return missing_as_null(df)


def _named_like(schema: T.StructType, header: Sequence[str]) -> list[T.StructField]:
    """For each header cell the declared field of that trimmed name, or a text field that is not declared."""
    declared = {f.name: f for f in schema}
    return [declared.get(name.strip(), T.StructField(name.strip(), T.StringType())) for name in header]


def read_csv_by_name(spark: SparkSession, paths: Sequence[str], schema: T.StructType, fill_missing: bool = False) -> DataFrame:
    """Several CSV files (or folders of parts that share a header) whose columns are found by header name.

    The names of every file are read from its header and trimmed; files may list columns in another order and hold
    others besides. A declared column that a file does not have is an error, or NULL with ``fill_missing``; a name that
    occurs twice in a header is an error. Cells that do not parse are NULL.
    """
    tables = []
    for path in paths:
        # The header alone is read here; a path without any file or line has no columns.
        header = spark.read.option("header", True).csv(path).columns
        fields = _named_like(schema, header)
        names = [f.name for f in fields]
        twice = sorted({n for n in names if names.count(n) > 1})
        missing = [f.name for f in schema if f.name not in names]
        if twice or (missing and not fill_missing):
            raise ValueError(f"{path}: columns {twice or missing} {'occur twice' if twice else 'are missing'}")
        # Spark gives fields their names by place, and the places are those of this file's header.
        rows = spark.read.schema(T.StructType(fields)).option("header", True).option("enforceSchema", True).csv(path)
        tables.append(rows.select(*[F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]))
    if not tables:
        return spark.createDataFrame([], schema)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return missing_as_null(out)


def read_csv_quarantine(spark: SparkSession, paths: str | list[str], names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Headerless files as text: rows with one cell for each name, and the lines with fewer or more cells.

    Bad lines come with their cells, their number of cells and their file, so none is lost or shifted silently. Lines are
    read as text and cut by the CSV parser; cells with line breaks are not supported.
    """
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.trim("line") != "")
    # One cell more than declared shows a long line; what a short line lacks is missing from the parsed array.
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(len(names) + 1)), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    # Commas outside quotes: quoted parts are taken out first.
    count = F.regexp_count(F.regexp_replace("line", r'"([^"\\\\]|\\\\.|"")*"', ""), F.lit(",")) + 1
    rows = lines.withColumn("cells", cells).withColumn("n_cells", count.cast("int"))
    good = rows.where(F.col("n_cells") == len(names)).select(*[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)])
    return good, rows.where(F.col("n_cells") != len(names)).select("file", "n_cells", "line")


def read_csv_headerless(spark: SparkSession, paths: str | list[str], names: Sequence[str]) -> DataFrame:
    """Several headerless files under one declared name list, as text."""
    return spark.read.schema(text_schema(names)).option("header", False).csv(paths)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; filters and column lists above it reach the files."""
    return spark.read.parquet(path)


def clean_name(name: str) -> str:
    """Trimmed lower snake case: ``' Line One '`` and ``'Red/Blue & Green'`` become plain identifiers."""
    kept = "".join(ch if ch.isalnum() else " " for ch in name.strip().lower())
    return "_".join(kept.split())


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def trim_names(df: DataFrame) -> DataFrame:
    """Header blanks removed, spelling kept."""
    return df.toDF(*[c.strip() for c in df.columns])


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([nan_to_null(F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])
