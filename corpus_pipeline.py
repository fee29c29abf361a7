"""The corpus pipeline: five of the training-data operators, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecastops.llm import decontaminate, line_dedup, mixing, quality, simhash
from forecastops.llm.common import read, shared_rows

# Learned models and random orders have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that belong to another; ``n_chars`` follows the text."""
    new = {"text": F.col("row.text"), "n_chars": F.char_length("row.text").cast("long")}
    return line_dedup.dedup_rows(docs).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates (3-word shingles, at most two differing bits)."""
    return simhash.first_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture uses: id, source, words, words taken (repeats counted) and first slot."""
    placed, targets, mixture = mixing.mix_sources(docs)
    mixture = shared_rows(mixture)
    first = mixture.groupBy("source", "begin", "doc_id", "size").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    per = targets.select(F.col("source").alias("of"), "source_size", "target")
    return first.join(per, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


STAGES = [("quality classifier", keep_good), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_duplicates),
          ("benchmark decontamination", drop_contaminated), ("mixing sources", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_rows(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
