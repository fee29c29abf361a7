"""Quality rules by distribution divergence, with built-in functions only.

Each document gives two histograms: how its characters spread over character classes, and how its words spread over
the common words of its language (those in most documents; all others count together). Each is compared with the
language's own histogram, gathered from all documents that pass the base rules, by Jensen-Shannon distance (base 2,
so between 0 and 1). A document is kept if both distances are small; a histogram of too few words says little, so
below a minimum length it is not judged. Words are compared with their case and punctuation.

Languages beyond the ``max_languages`` most frequent (None: no limit), and null, have no reference of their own. With
``pool_unknown`` they are compared with the histogram of all documents that pass the base rules, and so are languages
whose passing documents have fewer than ``min_reference_words`` words: a few documents would only be compared with
themselves. Without it, such rows together are their own reference. The common words are then those of all documents
in either case. Per-language tables are broadcast when measured small, and otherwise joined with every language dealt
to several tasks.

Defined results: null and blank texts have no words and fail the base rule of minimum length. Rows are judged one by
one, repeated ids included; ties among common words are broken by the word; an empty table gives an empty table.
Texts are used whole; a text must fit in a row. Only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastops.llm.common import BLANKS, plain_text, salted_lookup, shared_rows, words
from forecastops.operators.joins import is_small

CLASSES = ("lower", "upper", "digit", "mark", "symbol", "blank")
ALL_LANGUAGES = ""


def repeated_words(tokens: str, window: int = 3) -> list[tuple[str, Column]]:
    """Named column steps that end in ``n_repeat_words``: words covered by windows found twice or more.

    The windows are sorted by hash next to their position, so equal ones are neighbours: no pairs are formed. Texts
    without equal windows skip the sort.
    """
    w = F.col(tokens)
    last = F.size(w) - window
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    placed = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return [
        ("__hashes", F.when(last >= 1, hashed)),
        ("__windows", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.sort_array(placed))),
        ("__again", F.filter("__windows", lambda x, k: F.coalesce(x["h"] == F.get(F.col("__windows"), k - 1)["h"], F.lit(False))
                             | F.coalesce(x["h"] == F.get(F.col("__windows"), k + 1)["h"], F.lit(False)))),
        ("n_repeat_words", F.coalesce(F.aggregate(
            F.sort_array(F.transform("__again", lambda x: x["i"])),
            F.struct(F.lit(-window).alias("at"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(window), i - a["at"])).cast("long").alias("n")),
            lambda a: a["n"]), F.lit(0).cast("long"))),
    ]


def by_language(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``lang``."""
    return rows.join(F.broadcast(table), "lang", "left") if is_small(table) else salted_lookup(rows, table, "lang")


def common_words(rows: DataFrame, common: int, max_languages: int | None) -> DataFrame:
    """For each language the ``common`` words in most of its documents, as a map to their rank (from 1).

    The row with an empty language is for all documents together.
    """
    seen = shared_rows(rows.select("lang", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).groupBy("lang", "word").agg(
        F.count("*").alias("n")))
    own = seen.where(F.col("lang") != ALL_LANGUAGES)
    if max_languages is not None:
        largest = shared_rows(rows.where(F.col("lang") != ALL_LANGUAGES).groupBy("lang").agg(F.count("*").alias("docs")).orderBy(
            F.desc("docs"), "lang").limit(max_languages).select("lang"))
        own = own.join(F.broadcast(largest) if is_small(largest) else largest, "lang", "left_semi")
    pooled = seen.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ALL_LANGUAGES).alias("lang"), "word", "n")
    listed = own.unionByName(pooled)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = listed.withColumn("rank", rank).where(F.col("rank") <= common)
    return top.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "rank"))).alias("ranks"))


def pooled_words(ranks: DataFrame) -> list[str]:
    """The common words of all documents in their order (as many as are listed for a language, so few)."""
    row = ranks.where(F.col("lang") == ALL_LANGUAGES).first()
    return sorted(row["ranks"], key=row["ranks"].get) if row else []


def statistics(rows: DataFrame, ranks: DataFrame, common: int, pool: list[str] | None = None) -> DataFrame:
    """Base counts, base rule, and class and common-word counts of every document; ``lang`` is the reference's.

    With ``pool``, the common words of all documents, ``pool_hits`` holds the counts of these.
    """
    rows = by_language(rows, ranks.select("lang", F.col("lang").alias("known"))).select(
        "doc_id", F.coalesce("known", F.lit(ALL_LANGUAGES)).alias("lang"), "text")
    # One character for each rank: counting a character of a short string is much cheaper than counting array elements.
    marks = F.array(*[F.lit(chr(48 + k)) for k in range(common)])
    rows = by_language(rows, ranks.select("lang", F.transform_values("ranks", lambda _, r: F.get(marks, r - 1)).alias("marks")))
    rows = rows.withColumn("__words", words(F.col("text")))
    rows = rows.withColumn("__lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    rows = rows.withColumn("__found", F.array_join(F.transform("__words", lambda w: F.col("marks")[w]), ""))
    if pool:
        # Looked up in a hash set first: few words are listed.
        place = F.create_map(*[F.lit(x) for k, w in enumerate(pool) for x in (w, chr(48 + k))])
        rows = rows.withColumn("__pooled", F.array_join(F.transform(F.filter("__words", lambda w: w.isin(pool)), lambda w: place[w]), ""))
    # What is neither a lower-case letter, a letter without case nor a blank: short for prose, and counted by class.
    rows = rows.withColumn("__rest", F.regexp_replace("text", r"[\p{Ll}\p{Lo}\s]+", ""))
    for name, column in repeated_words("__words"):
        rows = rows.withColumn(name, column)
    only = lambda keep: F.length(F.regexp_replace("__rest", f"[^{keep}]+", "")).cast("long")

    def counted(found: str, of: Column) -> Column:
        return F.transform(of, lambda c: (F.length(found) - F.length(F.replace(F.col(found), c, F.lit("")))).cast("long"))

    rows = rows.select(
        "doc_id", "lang", F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), F.length("text").cast("long").alias("__chars"),
        (F.length("__rest") - F.length(F.regexp_replace("__rest", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        counted("__found", marks).alias("__listed"),
        (counted("__pooled", F.slice(marks, 1, len(pool))) if pool else F.array().cast("array<bigint>")).alias("__pool"),
        only(r"\p{Lu}").alias("__upper"), only(r"\p{N}").alias("__digit"), only(r"\p{P}").alias("__mark"), F.length("__rest").cast("long").alias("__other"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    classes = [F.col("word_chars") - F.col("__other"), F.col("__upper"), F.col("__digit"), F.col("__mark"),
               F.col("__other") - F.col("__upper") - F.col("__digit") - F.col("__mark"), F.col("__chars") - F.col("word_chars")]

    def with_others(counts: Column) -> Column:
        return F.concat(counts, F.array(F.col("n_words") - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)))

    out = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           failed.alias("base_failed"), F.array(*classes).alias("classes"), with_others(F.col("__listed")).alias("hits")]
    if pool is not None:
        out.append(with_others(F.col("__pool")).alias("pool_hits"))
    return rows.select(*out)


def _histogram_sums(rows: DataFrame, sizes: dict[str, int], *keys: str) -> DataFrame:
    """Sums of the count arrays in ``sizes`` (column to length) over passing documents as ``ref_<column>``, and their ``ref_words``."""
    def sums(column: str, n: int) -> list[Column]:
        return [F.sum(F.when(~F.col("base_failed"), F.get(column, F.lit(k)))).alias(f"{column}{k}") for k in range(n)]

    def gather(column: str, n: int) -> Column:
        return F.array(*[F.coalesce(F.col(f"{column}{k}"), F.lit(0).cast("long")) for k in range(n)]).alias(f"ref_{column}")

    read = F.coalesce(F.sum(F.when(~F.col("base_failed"), F.col("n_words"))), F.lit(0)).alias("ref_words")
    wide = rows.groupBy(*keys).agg(read, *[c for name, n in sizes.items() for c in sums(name, n)])
    return wide.select(*keys, "ref_words", *[gather(name, n) for name, n in sizes.items()])


def language_references(rows: DataFrame, common: int) -> DataFrame:
    """One row for each language: the sums of its documents' histograms (``ref_classes``, ``ref_hits``).

    Every document that passes the base rules counts; the row with an empty language is for those without one.
    """
    return _histogram_sums(rows, {"classes": len(CLASSES), "hits": common + 1}, "lang")


def with_references(rows: DataFrame, common: int, pool: list[str] | None, min_reference_words: int) -> DataFrame:
    """``rows`` with ``ref_classes`` and ``ref_hits``; ``hits`` are of the words that the reference counts."""
    references = shared_rows(language_references(rows, common))
    if pool is None:
        return by_language(rows, references)
    # One row of sums over all documents, so it goes along as constants.
    whole = _histogram_sums(rows, {"classes": len(CLASSES), "pool_hits": len(pool) + 1}).first()
    constant = lambda name: F.array(*map(F.lit, whole[name])).cast("array<bigint>")
    own = references.where((F.col("lang") != ALL_LANGUAGES) & (F.col("ref_words") >= min_reference_words))
    rows = by_language(rows, own)
    alone = F.col("ref_words").isNotNull()
    return rows.withColumns({"hits": F.when(alone, F.col("hits")).otherwise(F.col("pool_hits")),
                             "ref_hits": F.when(alone, F.col("ref_hits")).otherwise(constant("ref_pool_hits")),
                             "ref_classes": F.when(alone, F.col("ref_classes")).otherwise(constant("ref_classes"))})


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)


def jensen_shannon(a: str, b: str) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; null where one has no counts."""
    total_a, total_b = _total(F.col(a)), _total(F.col(b))

    def part(x, y):
        mean = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / mean)).otherwise(0.0)

    shares = lambda c, total: F.transform(c, lambda x: x / total)
    parts = F.zip_with(shares(a, total_a), shares(b, total_b), part)
    divergence = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((total_a > 0) & (total_b > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judge(docs: DataFrame, common: int = 20, max_languages: int | None = 1000, min_class_words: int = 20, min_word_words: int = 50,
          max_class_distance: float = 0.15, max_word_distance: float = 0.45, pool_unknown: bool = False, min_reference_words: int = 1000) -> DataFrame:
    """Base counts, both distances and ``kept`` of every document.

    A distance is judged from ``min_class_words`` and ``min_word_words`` words on.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit(ALL_LANGUAGES)).alias("lang"), plain_text(F.col("text")).alias("text"))
    ranks = shared_rows(common_words(rows, common, max_languages))
    pool = pooled_words(ranks) if pool_unknown else None
    joined = with_references(shared_rows(statistics(rows, ranks, common, pool)), common, pool, min_reference_words)
    joined = joined.withColumn("class_distance", jensen_shannon("classes", "ref_classes")).withColumn(
        "word_distance", jensen_shannon("hits", "ref_hits"))
    n = F.col("n_words")
    far = ((n >= min_class_words) & (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance)
           | (n >= min_word_words) & (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")
