"""Line deduplication against levelled sorted runs of line hashes.

Documents arrive in batches. The keys a batch brings are merge-anti-joined with the runs written so far; new keys
become a run of their own, sorted by hash, with the document that owns them. When a level holds ``fanout`` runs they
are merged into one run of the next level, so a key is rewritten only a logarithmic number of times.

A key is the line without blanks at both ends, A-Z lowered, if it has at least ``min_chars`` code points; its hash is
the 128-bit MD5. A line is dropped where its key belongs to another document: to one of an earlier batch, or to one of
the same batch with a smaller id. With batches in id order the owner is the smallest id of all.

Defined results: null or empty text is one empty line; rows with one id (repeated rows) are one document, and rows
without an id are together one document after all others; a document that loses all lines keeps an empty text; an
empty table gives an empty table. Long texts are split whole. Other columns pass through untouched, unless they
begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecastops.llm.common import BLANKS, ascii_lower, plain_text, shared_rows
from forecastops.session import remove_path, scratch_path

MIN_CHARS = 10
BATCHES, FANOUT = 6, 4  # more batches than the fanout: the last ones join a compacted run
RUN_SCHEMA = "h binary, owner bigint"


class LineRuns:
    """The runs of all keys seen so far, by level; each run is a Parquet table sorted by hash within its files."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def read(self) -> DataFrame:
        """All keys with their owners; every key is in one run only."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths)

    def _write(self, level: int, rows: DataFrame) -> None:
        path = scratch_path(self.spark, f"run{level}")
        rows.select("h", "owner").repartition("h").sortWithinPartitions("h").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, firsts: DataFrame) -> None:
        """Add a run of the keys (``h``, ``owner``) that no run holds yet, then compact full levels."""
        held = self.read().select("h").hint("merge")
        self._write(0, firsts.select("h", "owner").join(held, "h", "left_anti"))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(level + 1, self.spark.read.schema(RUN_SCHEMA).parquet(*merged))
            for path in merged:
                remove_path(self.spark, path)
            level += 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _row_key() -> Column:
    """Same for rows with equal id and text: what a dropped line's position refers to."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), plain_text(F.col("text")))
    return F.unhex(F.md5(text.cast("binary")))


def _lines(docs: DataFrame, batch: Column, min_chars: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), _row_key().alias("row"), batch.cast("int").alias("batch"),
                       F.posexplode(F.split(plain_text(F.col("text")), "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return rows.select("doc", "row", "batch", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"))


def _dropped(runs: LineRuns, lines: DataFrame) -> DataFrame:
    """Row and position of the lines of one batch to drop; the batch's new keys go to the runs."""
    keys = lines.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"), F.count("doc").alias("ids"))
    held = runs.read().withColumn("held", F.lit(True))
    several = ~F.col("low").eqNullSafe(F.col("high")) | ((F.col("ids") > 0) & (F.col("ids") < F.col("n")))
    # Two-sided sort-merge join on the hash: the run's owner where it has one, else the batch's smallest id.
    decided = shared_rows(keys.join(held.hint("merge"), "h", "left").select(
        "h", F.when(F.col("held"), F.col("owner")).otherwise(F.col("low")).alias("owner"),
        (F.coalesce("held", F.lit(False)) | several).alias("shared")))
    # Of the lines, only (hash, row, position) travels; a key found everywhere is split by adaptive execution.
    drops = shared_rows(lines.join(decided.where("shared").select("h", "owner"), "h").where(
        ~F.col("doc").eqNullSafe(F.col("owner"))).select("row", "pos"))
    runs.add(decided)
    return drops


def id_batches(docs: DataFrame, batches: int) -> Column:
    """Batch number from 0: equal ranges of ids, ids in order; rows without an id come in the last batch."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return F.lit(0)
    width = max(1, -(-(high - low + 1) // batches))
    exact = lambda c: c.cast("decimal(20,0)")  # noqa: E731  differences of 64-bit ids need 65 bits, quotients all digits
    batch = F.call_function("div", exact(F.col("doc_id")) - exact(F.lit(low)), exact(F.lit(width)))
    return F.coalesce(F.least(batch, F.lit(batches - 1)), F.lit(batches - 1)).cast("int")


def dedup_rows(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """``row``: all columns of ``docs`` with ``text`` reduced to the kept lines; and ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    batch = id_batches(docs, batches)
    path = scratch_path(spark, "lines")
    lines = _lines(docs, batch, min_chars)
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs, drops = LineRuns(spark, fanout), None
    for k in range(batches):
        found = _dropped(runs, lines.where(F.col("batch") == k))
        drops = found if drops is None else drops.unionByName(found)
    by_row = drops.groupBy(F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__drop"))
    # The caller's columns travel in one struct, so their names cannot clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _row_key().alias("__row"))
    joined = own.join(by_row, "__row", "left").withColumn("lines", F.split(plain_text(F.col("row.text")), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("__drop", F.array().cast("array<int>")))
    joined = joined.withColumn("left", left)
    kept = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    return joined.select(F.struct(*[kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]).alias("row"),
                         F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` with the kept text, and ``__n_lines`` and ``__n_dropped`` (in place of columns so named)."""
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("__n_lines", "__n_dropped")]
    return dedup_rows(docs, **options).select(*kept, F.col("n_lines").alias("__n_lines"), F.col("n_dropped").alias("__n_dropped"))
