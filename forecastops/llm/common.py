"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecastops.session import cut_lineage

# The six ASCII blanks. A word is a longest run of other characters.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters, digits and underscores in any script.
TOKEN = re.compile(r"\w+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain_text(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.regexp_count(plain_text(text), F.lit(WORD_PATTERN)).cast("long")


def words(text: Column) -> Column:
    """All words of the whole text in order, as an array; empty for null or blank text."""
    trimmed = F.btrim(plain_text(text), F.lit(BLANKS))
    # In Spark's regular expressions \s is just these six blanks.
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32`` of the id's decimal text modulo ``parts``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % parts).cast("int")


def shared_rows(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back."""
    return cut_lineage(df)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join ``left`` to ``right``, whose ``key`` is unique, with every key of ``left`` dealt to ``salts`` tasks.

    For small ``right`` sides whose keys may each match a large share of ``left``.
    """
    spread = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "__salt"], how).drop("__salt")
