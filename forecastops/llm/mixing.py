"""Mixing sources to target weights by a low-discrepancy schedule.

Every source has its documents shuffled by a keyed hash and laid end to end; equal blocks of words are cut from that
line. The schedule is a row of slots: slot ``i`` takes the golden-ratio point ``frac(i * phi)``, which falls into one
source's interval of the cumulative weights. The n-th slot of a source takes its n-th block, and starts over once all
blocks are used. Points of that sequence are spread so evenly that every stretch of the schedule has each source near
its weight; a source ends when its target is filled, in the middle of a block if need be, and the few slots a source
still lacks when the row ends are added behind it.

Targets: sources ordered by code point (null last) weigh 5, 2, 1, repeating, and share ``budget`` times all words. No
target exceeds ``max_epochs`` times its source's words; what lies above is shared again by weight among the others.

Defined results: null text has size 0, and so no words to take; a null source is a source of its own; rows are
placed one by one, repeated rows too (equal rows are interchangeable); documents of any length are cut across blocks;
an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecastops.llm.common import shared_rows, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 512
SEED = "mix"
# Golden ratio as a fraction of 2**31; the numerator is odd, so the points repeat only after 2**31 slots.
PHI_MODULUS = 1 << 31
PHI_STEP = round(PHI_MODULUS * (math.sqrt(5) - 1) / 2) | 1
BUCKETS = 4096
SLOT_CHUNK = 1 << 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``target`` from one row for each source (``source``, ``source_size``).

    Filled like water: targets are ``min(cap, level * weight)``. Ordered by cap over weight, the sources before some
    place are full, and the level follows from what is left; the windows run over one row for each source.
    """
    rows = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("n") - 1) % len(weights)).cast("double")
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before, after, everything = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(budget))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    open_level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "n", "level"))).over(everything)
    rows = rows.withColumn("open", open_level["level"])
    target = F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def shuffled(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``begin``: where the document starts in its source's shuffled line of words.

    The running sum goes first over buckets of the hash, then within each, so no source is summed in one task.
    """
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string")).cast("binary"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"))
    rows = shared_rows(rows.withColumn("bucket", (F.conv(F.substring("key", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc_id", "source", "size", (F.col("start") + F.col("inside")).cast("long").alias("begin"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS, chunk: int = SLOT_CHUNK) -> DataFrame:
    """Slots: ``slot`` (order), ``source``, ``epoch``, ``block`` and ``words`` taken from the block's start.

    All of the block's words are taken, or fewer in a source's last slot.
    """
    rows = targets.withColumn("goal", F.floor("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("goal") - epochs * F.col("source_size")
    rows = rows.withColumn("quota", (epochs * F.col("blocks") + F.ceil(rest / block_words)).cast("long")).where(F.col("quota") > 0)
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("upto", F.sum("quota").over(by_source)).withColumn("total", F.sum("quota").over(Window.partitionBy()))
    edge = lambda c: F.floor(c / F.col("total") * PHI_MODULUS).cast("long")
    rows = shared_rows(rows.withColumn("low", edge(F.col("upto") - F.col("quota"))).withColumn("high", edge(F.col("upto"))))
    total = rows.agg(F.max("total")).first()[0] or 0
    # A point meets the sources of its cell only: an equality join, then the interval.
    cell = lambda c: F.shiftright(c, 19)
    point = F.col("slot") % PHI_MODULUS * PHI_STEP % PHI_MODULUS
    slots = targets.sparkSession.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / chunk).alias("chunk"))
    slots = slots.withColumn("point", point).withColumn("cell", cell(F.col("point")))
    cells = rows.where(F.col("high") > F.col("low")).select("source", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    slots = slots.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "chunk", "source")
    # Rank among the source's slots: position in the chunk plus the counts of earlier chunks.
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared_rows(counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select(
        "slot", F.col("source").alias("of"), (F.col("start") + F.col("inside")).cast("long").alias("rank"))
    main = rows.join(ranked, F.col("source").eqNullSafe(F.col("of"))).where(F.col("rank") < F.col("quota"))
    got = starts.groupBy("s").agg(F.sum("n").alias("got"))
    behind = rows.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < F.col("quota"))
    behind = behind.withColumn("at", F.sum(F.col("quota") - F.col("got")).over(by_source) - (F.col("quota") - F.col("got")) + F.col("total"))
    behind = behind.withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("quota") - 1))).withColumn("slot", F.col("at") + F.col("rank") - F.col("got"))
    keep = ["slot", "source", "rank", "blocks", "source_size", "goal"]
    slots = main.select(*keep).unionByName(behind.select(*keep))
    slots = slots.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")).cast("long")).withColumn("block", F.col("rank") % F.col("blocks"))
    at = F.col("block") * block_words
    taken = F.least(F.lit(block_words), F.col("source_size") - at, F.col("goal") - F.col("epoch") * F.col("source_size") - at)
    return slots.select("slot", "source", "epoch", "block", taken.cast("long").alias("words"))


def mix(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture: which words of which documents each slot takes.

    ``slot``, ``epoch``, ``source``, ``doc_id``, ``begin`` and ``size`` of the document, ``first`` (word of the
    document, from 0) and ``words``. A block holds at most ``block_words`` pieces, so no join key is hot.
    """
    of = lambda c: F.floor(c / block_words)
    pieces = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(of(F.col("begin")), of(F.col("begin") + F.col("size") - 1))))
    slots = slots.select("slot", "epoch", F.col("source").alias("s"), F.col("block").alias("b"), F.col("words").alias("taken"))
    joined = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    start = F.col("block") * block_words
    low, high = F.greatest("begin", start), F.least(F.col("begin") + F.col("size"), start + F.col("taken"))
    return joined.where(high > low).select("slot", "epoch", "source", "doc_id", "begin", "size", (low - F.col("begin")).alias("first"), (high - low).alias("words"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents, targets and mixture (see ``shuffled``, ``source_targets`` and ``mix``)."""
    placed = shared_rows(shuffled(docs))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = shared_rows(source_targets(sizes, weights, budget, max_epochs))
    slots = shared_rows(schedule(targets, block_words))
    return placed, targets, mix(placed, slots, block_words)


def taken_words(placed: DataFrame, targets: DataFrame, mixture: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` of every document."""
    key = ["source", "begin", "doc_id", "size"]
    none = placed.select(*key, F.lit(0).cast("long").alias("words"))
    taken = mixture.select(*key, "words").unionByName(none.where(F.col("size") > 0)).groupBy(*key).agg(F.sum("words").alias("taken"))
    rows = taken.unionByName(none.where(F.col("size") == 0).withColumnRenamed("words", "taken"))
    per = targets.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(per, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "taken")
