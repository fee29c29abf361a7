"""Document fingerprints by winnowing, with built-in functions only.

A text is cut into pieces: runs of at most ``MAX_PIECE`` code points without ASCII blanks, ideographs one by one. Every
``gram`` pieces in a row give a hash; hashes of twice the length come from two neighbouring ones, so a gram of any length
takes a few passes over the array however long the text is. Of every ``window`` neighbouring hashes the smallest is a mark,
the rightmost one where several are equal, found by the same doubling. A mark keeps its hash (33 bits) and the
number of its first piece. Any passage of ``gram + window - 1`` pieces that two texts share gives them a common mark, and
nothing shorter than ``gram`` pieces does.

The likeness of two texts is the Jaccard similarity of their sets of mark hashes.

Defined results: null texts are empty; a text without pieces has no marks, and two texts without marks are alike (1); a
text of fewer than ``gram`` pieces has one mark, the hash of them all. Texts are used whole; a text must fit in a row.
``beside_next`` orders rows by id (null first) and then by a hash of id and text, so ties and repeated rows have a
defined order: a repeated row's next document is its copy, the last copy's the one that follows. An empty table gives an
empty table. Only ``doc_id`` and ``text`` are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastops.llm.common import plain_text, shared_rows

GRAM, WINDOW = 4, 8
MAX_PIECE = 16
PIECES = rf"\p{{IsIdeographic}}|[^\s\p{{IsIdeographic}}]{{1,{MAX_PIECE}}}"
PLACES = 2**30


def _shifts(size: int) -> list[int]:
    """Shifts by which spans of one element grow to ``size``: each step joins a span and the one so much later."""
    out, have = [], 1
    while have < size:
        out.append(min(have, size - have))
        have += out[-1]
    return out


def _grown(rows: DataFrame, column: str, size: int, join) -> tuple[DataFrame, str]:
    """Column whose element ``i`` joins the elements ``i`` to ``i + size - 1`` of ``column``, as far as there are any."""
    for k, shift in enumerate(_shifts(size)):
        later = F.slice(column, F.lit(shift + 1), F.size(column))
        rows, column = rows.withColumn(f"{column}_{k}", F.zip_with(column, later, join)), f"{column}_{k}"
    return rows, column


def with_packed_marks(rows: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``rows`` with ``name``: the text's marks by position, each one number of hash (above) and position (below)."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != name]
    rows = rows.withColumn("__pieces", F.regexp_extract_all(plain_text(F.col(text)), F.lit(PIECES), F.lit(0)))
    size = F.size("__pieces")
    rows, grams = _grown(rows, "__pieces", gram, lambda a, b: F.xxhash64(a, b))
    if gram == 1:
        rows, grams = rows.withColumn("__hashes", F.transform(grams, lambda x: F.xxhash64(x))), "__hashes"
    whole = F.slice(grams, F.lit(1), F.greatest(size - (gram - 1), F.least(size, F.lit(1))))
    # Later places are smaller below: the least number is the smallest hash, the rightmost of equal ones.
    rows = rows.withColumn("__placed", F.transform(whole, lambda h, i: F.shiftrightunsigned(h, 31) * F.lit(PLACES) + (PLACES - 1 - i)))
    placed = F.size("__placed")
    rows, least = _grown(rows, "__placed", window, lambda a, b: F.least(a, b))
    chosen = F.array_distinct(F.slice(least, F.lit(1), F.greatest(placed - (window - 1), F.least(placed, F.lit(1)))))
    return rows.select(*kept, chosen.alias(name))


def _hash(packed: Column) -> Column:
    return F.call_function("div", packed, F.lit(PLACES))


def unpacked(marks: Column) -> Column:
    """Marks as ``hash`` and ``position``."""
    return F.transform(marks, lambda x: F.struct(_hash(x).alias("hash"), (PLACES - 1 - x % PLACES).cast("int").alias("position")))


def hashes(marks: str) -> Column:
    """The different hashes of packed marks."""
    return F.array_distinct(F.transform(marks, _hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of different hashes; 1 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(1.0))


def spelled(marks: str) -> Column:
    """Digest of all packed marks with their positions."""
    listed = F.transform(unpacked(F.col(marks)), lambda m: F.concat_ws("@", m["hash"].cast("string"), m["position"].cast("string")))
    return F.sha2(F.array_join(listed, ",").cast("binary"), 256)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id`` and ``marks`` of every row."""
    return with_packed_marks(docs.select("doc_id", "text"), "text", "marks", gram, window).select("doc_id", unpacked(F.col("marks")).alias("marks"))


def row_key() -> Column:
    """Same for rows with equal id and text."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), plain_text(F.col("text")))
    return F.unhex(F.md5(text.cast("binary")))


def next_rows(docs: DataFrame) -> DataFrame:
    """For each different row its key and those of the rows that follow: ``row``, ``doc_id``, ``n_chars``, ``next_row``, ``times``.

    Keys are dealt to ranges; a range takes its last successor from a table with one row for each range. A row that
    occurs several times has a second entry in which it follows itself. The last row is followed by the first.
    """
    spark = docs.sparkSession
    keys = docs.select("doc_id", row_key().alias("row"), F.char_length(plain_text(F.col("text"))).cast("long").alias("n_chars"))
    keys = keys.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    keys = shared_rows(keys.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    firsts = keys.groupBy("part").agg(F.min(F.struct("doc_id", "row"))["row"].alias("first"))
    # One row for each range: their number is a setting, not one of the data's.
    along, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(whole)).alias("after"))
    keys = keys.join(F.broadcast(after), "part")
    follows = F.coalesce(F.lead("row").over(Window.partitionBy("part").orderBy(*order)), F.col("after"))
    keys = keys.select("row", "doc_id", "n_chars", "copies", follows.alias("next_row"))
    entries = F.array(F.struct(F.col("next_row"), F.lit(1).cast("long").alias("times")), F.struct(F.col("row").alias("next_row"), (F.col("copies") - 1).alias("times")))
    return keys.select("row", "doc_id", "n_chars", F.explode(entries).alias("e")).where(F.col("e.times") > 0).select(
        "row", "doc_id", "n_chars", "e.next_row", "e.times")


def beside_next(docs: DataFrame, share: int = 4, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every row's text and packed marks, its edited text with its marks, and the marks' hashes of the row that follows.

    In the edited text the last ``n_chars // share`` code points give way to the first as many of the next row's text.
    """
    rows = docs.select("doc_id", plain_text(F.col("text")).alias("text")).withColumn("row", row_key())
    marked = with_packed_marks(rows.select("row", "text"), "text", "marks", gram, window)
    # One row for each key, dealt by it once: both joins below read this exchange.
    own = marked.groupBy("row").agg(F.first(F.struct("text", "marks")).alias("own"))
    plan = next_rows(docs)
    lost = F.floor(F.col("n_chars") / share).cast("int").alias("lost")
    asked = plan.select(F.col("row").alias("of"), "doc_id", "n_chars", F.col("next_row"), "times", lost)
    sent = own.join(asked.hint("merge"), own["row"] == asked["next_row"]).select(
        "of", "doc_id", "n_chars", "times", "lost", F.substr("own.text", F.lit(1), F.col("lost")).alias("prefix"), hashes("own.marks").alias("next_hashes"))
    both = own.join(sent.hint("merge"), own["row"] == sent["of"])
    edited = F.concat(F.substr("own.text", F.lit(1), (F.col("n_chars") - F.col("lost")).cast("int")), F.col("prefix"))
    both = both.select("doc_id", "n_chars", "times", F.col("own.text").alias("text"), F.col("own.marks").alias("marks"), edited.alias("edited"), "next_hashes")
    return with_packed_marks(both, "edited", "edited_marks", gram, window)


def fingerprint_report(rows: DataFrame) -> DataFrame:
    """Digests and likenesses of every row of ``beside_next``, repeated rows as often as they occur."""
    rows = rows.withColumn("own", hashes("marks"))
    out = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spelled("marks").alias("fingerprint"),
                      spelled("edited_marks").alias("edited_fingerprint"), likeness(F.col("own"), hashes("edited_marks")).alias("near_edited"),
                      likeness(F.col("own"), F.col("next_hashes")).alias("near_next"), F.size("marks").cast("long").alias("n_marks"), "times")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).drop("times", "copy")
