"""Toxicity by class-conditional models of a word after the word before it, backing off to shared counts.

One model for toxic and one for ordinary text give every word a probability. Expressions are counted by the different
documents that hold them, however often, as Kneser-Ney counts contexts. Each class backs off from a word after the word before
it to the word, then to its first six, five and four letters, and at last to counts that both classes share. At every
level the level below says how many of an expression's documents each class should hold; absolute discounting takes
up to ``discount`` deviations off what a class holds more or less than that, and gives it back to the level below.
So a rare expression, or one no more frequent in one class than the level below has it, keeps the shared counts and
says nothing about the class. A document's figure is its log-likelihood ratio divided by its number of words; a
logistic curve turns it into a score. An unseen word has the probability of its longest known beginning.

Words are lower-cased runs of letters and digits, counted in Spark over all labelled documents outside the held-out
fold; pairs of words by 64-bit hashes of both. The model is a table with a row for each expression whose share departs
from the level below, however many there are: up to ``max_local`` rows it is sent to the tasks, beyond that the
documents' own expressions are joined to it, hot ones dealt to several tasks. The curve is fitted to at most
``max_rows`` of the labelled documents (first by a hash of the id).

Defined results: null and empty texts have ratio 0 and the score of it; null labels and labels without a document
are left out; without any labelled row, or with one class only, every ratio is 0 and the score is the smoothed share
of toxic rows; repeated rows count and score alike; texts are read whole; an empty table gives an empty table. Only
``doc_id`` and ``text`` of documents and the label column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.llm.common import TOKEN, fold, plain_text, salted_lookup, shared_rows
from forecastops.operators.joins import is_small

HOLD_OUT, HELD = 3, 1
THRESHOLD = 0.7
DISCOUNT = 3.0
MAX_LOCAL = 200_000
MAX_ROWS = 20_000
PREFIXES = (4, 5, 6, 0)  # 0: the word itself
FLUSH = 1_000_000
CACHE_WORDS = 500_000


def word_hash(word: str) -> int:
    """What ``xxhash64`` of the word gives in Spark, as a signed number."""
    value = xxhash.xxh64_intdigest(word.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


class Hashes(dict):
    """Hash of each word met, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = word_hash(word)
        return value


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """``id``, ``text`` and ``toxic`` (0/1) of the labelled documents outside the held-out fold."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("mark")).where(F.col("mark").isNotNull() & (fold(F.col("id"), parts) != held))
    rows = docs.select(F.col("doc_id").alias("id"), plain_text(F.col("text")).alias("text")).where(fold(F.col("id"), parts) != held)
    # Few labels are broadcast, so that texts stay where they are read; more are shuffled.
    return rows.join(F.broadcast(marks) if is_small(marks) else marks.hint("merge"), "id").select("id", "text", (F.col("mark") > 0).cast("int").alias("toxic"))


def count_expressions(rows: DataFrame) -> DataFrame:
    """Documents of either class with each word (``word``; ``first`` and ``second`` 0) and each word pair (``word`` null).

    Counts are summed within tasks first, a bounded number of expressions at a time.
    """
    def table(words: dict, pairs: dict) -> pd.DataFrame:
        codes = np.zeros((len(words) + len(pairs), 2), np.int64)
        codes[len(words):] = np.array(list(pairs), np.int64).reshape(-1, 2)
        counts = np.array([*words.values(), *pairs.values()], np.int64)
        return pd.DataFrame({"word": [*words, *[None] * len(pairs)], "first": codes[:, 0], "second": codes[:, 1],
                             "toxic": counts >> 32, "ordinary": counts & 0xFFFFFFFF})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, pairs, hashes = {}, {}, Hashes()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                one = 1 << 32 if toxic else 1
                found = TOKEN.findall(text.lower())
                coded = [hashes[w] for w in found]
                for word in set(found):
                    words[word] = words.get(word, 0) + one
                for pair in set(zip(coded, coded[1:])):
                    pairs[pair] = pairs.get(pair, 0) + one
                if len(words) + len(pairs) >= FLUSH:
                    yield table(words, pairs)
                    words, pairs = {}, {}
        if words:
            yield table(words, pairs)

    parts = rows.select("text", "toxic").mapInPandas(run, "word string, first long, second long, toxic long, ordinary long")
    return parts.groupBy("word", "first", "second").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def departures(rows: DataFrame, discount: float) -> DataFrame:
    """Rows of ``toxic`` and ``ordinary`` counts that depart from the expected share by more than the discount.

    ``toxic_all`` and ``ordinary_all`` hold what the class counts should be in proportion to. Added: ``toxic_part`` and
    ``ordinary_part``, how many times the expected count the discounted one is.
    """
    n, whole = F.col("toxic") + F.col("ordinary"), F.col("toxic_all") + F.col("ordinary_all")

    def part(name: str) -> Column:
        expected = n * F.col(f"{name}_all") / whole
        gap = F.col(name) - expected
        kept = F.signum(gap) * F.greatest(F.abs(gap) - discount * F.sqrt(expected + 1), F.lit(0.0))
        return ((expected + kept + 0.5) / (expected + 0.5)).alias(f"{name}_part")

    # A gap is never larger than the count, and the discount never smaller than ``discount``.
    rows = rows.where((n > discount) & (whole > 0))
    return rows.select("*", part("toxic"), part("ordinary")).where((F.col("toxic_part") != 1) | (F.col("ordinary_part") != 1))


def expression_table(rows: DataFrame, discount: float) -> DataFrame:
    """Every expression whose class shares depart from the level below, with how far, written once."""
    # Pairs in no more documents than the discount cannot depart: they are counted, but not written.
    counts = shared_rows(count_expressions(rows).where(F.col("word").isNotNull() | (F.col("toxic") + F.col("ordinary") > discount)))
    words = counts.where(F.col("word").isNotNull())
    totals = words.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.coalesce(F.sum("ordinary"), F.lit(0)).alias("o")).first()
    levels, below, length = [], None, 0
    for prefix in PREFIXES:
        key = F.substring("word", 1, prefix) if prefix else F.col("word")
        own = words.groupBy(key.alias("key")).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")) if prefix else words.select(
            key.alias("key"), "toxic", "ordinary")
        own = own.where(F.col("toxic") + F.col("ordinary") > discount)
        if below is None:
            own = own.select("*", F.lit(1.0).alias("t"), F.lit(1.0).alias("o"))
        else:
            own = own.withColumn("stem", F.substring("key", 1, length)).join(below, "stem", "left").select(
                "key", "toxic", "ordinary", F.coalesce("t", F.lit(1.0)).alias("t"), F.coalesce("o", F.lit(1.0)).alias("o"))
        own = own.select("*", (F.col("t") * float(totals["t"])).alias("toxic_all"), (F.col("o") * float(totals["o"])).alias("ordinary_all"))
        found = shared_rows(departures(own, discount).select("key", "t", "o", "toxic_part", "ordinary_part"))
        levels.append(found.select(F.lit(prefix).alias("level"), "key", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("second"),
                                   "toxic_part", "ordinary_part"))
        # A key's whole factor: its own, or that of the longest beginning that has one.
        here = found.select("key", (F.col("t") * F.col("toxic_part")).alias("t"), (F.col("o") * F.col("ordinary_part")).alias("o"))
        if below is not None:
            reached = words.select(key.alias("key"), F.substring(key, 1, length).alias("stem")).join(below, "stem").select("key", "t", "o").distinct()
            reached = reached.join(here.select("key"), "key", "left_anti")
            here = here.unionByName(reached)
        below, length = shared_rows(here).withColumnRenamed("key", "stem"), prefix
    often = counts.where(F.col("word").isNull()).select("first", "second", "toxic", "ordinary")
    # The class shares of a pair go by the documents that hold its first word.
    contexts = words.select(F.xxhash64("word").alias("first"), F.col("toxic").alias("first_toxic"), F.col("ordinary").alias("first_ordinary")).groupBy("first").agg(
        F.sum("first_toxic").alias("first_toxic"), F.sum("first_ordinary").alias("first_ordinary")).join(often.select("first").distinct(), "first", "left_semi")
    factors = below.select(F.xxhash64("stem").alias("second"), "t", "o").groupBy("second").agg(F.max("t").alias("t"), F.max("o").alias("o")).join(
        often.select("second").distinct(), "second", "left_semi")
    often = salted_lookup(salted_lookup(often, contexts, "first", "inner"), factors, "second")
    often = often.select("first", "second", "toxic", "ordinary", (F.col("first_toxic") * F.coalesce("t", F.lit(1.0))).alias("toxic_all"),
                         (F.col("first_ordinary") * F.coalesce("o", F.lit(1.0))).alias("ordinary_all"))
    levels.append(departures(often, discount).select(F.lit(-1).alias("level"), F.lit(None).cast("string").alias("key"), "first", "second", "toxic_part", "ordinary_part"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return shared_rows(out.select("level", "key", "first", "second", F.log(F.col("toxic_part") / F.col("ordinary_part")).alias("gain")))


class LocalTable(dict):
    """A small model's rows in the memory of a task: gain, hash and gains of following words of each word met."""

    def __init__(self, rows: list):
        super().__init__()
        self.parts = {prefix: {} for prefix in PREFIXES}
        self.pairs: dict[int, dict[int, float]] = {}
        for level, key, first, second, gain in rows:
            if level < 0:
                self.pairs.setdefault(first, {})[second] = gain
            else:
                self.parts[level][key] = gain

    def __reduce__(self):
        return LocalTable, ([(-1, None, a, b, gain) for a, after in self.pairs.items() for b, gain in after.items()]
                            + [(level, key, None, None, gain) for level, table in self.parts.items() for key, gain in table.items()],)

    def __missing__(self, word: str) -> tuple[float, int, dict | None]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        gain = sum(table.get(word[:prefix] if prefix else word, 0.0) for prefix, table in self.parts.items())
        code = word_hash(word)
        known = self[word] = (gain, code, self.pairs.get(code))
        return known

    def mean_ratio(self, text: str) -> float:
        found = TOKEN.findall(text.lower())
        total, after = 0.0, None
        for word in found:
            gain, code, follow = self[word]
            total += gain
            if after is not None:
                total += after.get(code, 0.0)
            after = follow
        return total / len(found) if found else 0.0


def text_expressions(text: str) -> tuple[int, dict[int, int]]:
    """Number of words of a text, and how often it holds each expression, by the expression's hash."""
    found, counts = TOKEN.findall(text.lower()), {}
    before = None
    for word in found:
        code = word_hash(word)
        keys = [xxhash.xxh64_intdigest(f"{p} {word[:p] if p else word}", 42) for p in PREFIXES]
        if before is not None:
            keys.append(xxhash.xxh64_intdigest(f"-1 {before} {code}", 42))
        for key in keys:
            key = key - (1 << 64) if key >> 63 else key
            counts[key] = counts.get(key, 0) + 1
        before = code
    return len(found), counts


class BackoffModel:
    """Log-likelihood ratio (toxic over ordinary) of texts, and the curve from a text's mean ratio to its score."""

    def __init__(self, table: DataFrame, max_local: int = MAX_LOCAL):
        self.table = table
        rows = table.limit(max_local + 1).collect()
        self.local = LocalTable([tuple(r) for r in rows]) if len(rows) <= max_local else None
        self.shift, self.slope = 0.0, 0.0

    def with_ratio(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` and the column ``ratio``: the mean log-likelihood ratio of their texts."""
        if self.local is not None:
            local = self.local

            @F.pandas_udf("double")
            def run(texts: pd.Series) -> pd.Series:
                return pd.Series([local.mean_ratio(t) for t in texts], dtype=float)

            return rows.withColumn("ratio", run(plain_text(F.col(text))))

        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row, value in zip(batch["row"], batch["text"]):
                    n, counts = text_expressions(value)
                    if n:
                        yield pd.DataFrame({"row": row, "code": list(counts), "share": [c / n for c in counts.values()]})

        kept = shared_rows(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("kept"), plain_text(F.col(text)).alias("text")).withColumn(
            "row", F.monotonically_increasing_id()))
        held = kept.select("row", "text").mapInPandas(emit, "row long, code long, share double")
        name = F.when(F.col("level") < 0, F.concat_ws(" ", F.col("first").cast("string"), F.col("second").cast("string"))).otherwise(F.col("key"))
        table = self.table.select(F.xxhash64(F.concat_ws(" ", F.col("level").cast("string"), name)).alias("code"), "gain").groupBy("code").agg(F.sum("gain").alias("gain"))
        ratios = salted_lookup(held, table, "code", "inner").groupBy("row").agg(F.sum(F.col("share") * F.col("gain")).alias("ratio"))
        return kept.join(ratios, "row", "left").select("kept.*", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))

    def mean_ratio(self, text: str) -> float:
        if self.local is not None:
            return self.local.mean_ratio(text)
        return self.with_ratio(self.table.sparkSession.createDataFrame([(text,)], "text string")).first()["ratio"]

    def word_ratio(self, word: str) -> float:
        """Ratio of a word whatever stands before it."""
        return self.local[word][0] if self.local is not None else self.mean_ratio(word)

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> "BackoffModel":
        """Fit the curve by Newton steps; a small penalty keeps the slope finite where the classes separate."""
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.shift, self.slope = float(np.log(share / (1 - share))), 0.0
        if not 0 < y.sum() < len(y):
            return self
        design, w = np.stack([np.ones(len(x)), x], 1), np.array([self.shift, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
            grad = design.T @ (y - p) - ridge * w
            hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
            step = np.linalg.solve(hess, grad)
            w = w + step * min(1.0, 20.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        self.shift, self.slope = float(w[0]), max(0.0, float(w[1]))
        return self

    def score(self, ratios: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shift + self.slope * ratios, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = HOLD_OUT, held: int = HELD, max_rows: int = MAX_ROWS,
          discount: float = DISCOUNT, max_local: int = MAX_LOCAL) -> BackoffModel:
    model = BackoffModel(expression_table(training_rows(docs, labels, label, parts, held), discount), max_local)
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("mark")).where(F.col("mark").isNotNull() & (fold(F.col("id"), parts) != held))
    marks = marks.orderBy(F.xxhash64("id"), "id", "mark").limit(max_rows)
    sample = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(marks), "id").select((F.col("mark") > 0).cast("double").alias("y"), "text")
    pairs = np.array(sorted((r["ratio"], r["y"]) for r in model.with_ratio(sample).select("ratio", "y").collect()), float).reshape(-1, 2)
    return model.calibrate(pairs[:, 0], pairs[:, 1])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    model = train(docs, labels, **options)
    curve = F.greatest(F.least(model.shift + model.slope * F.col("ratio"), F.lit(40.0)), F.lit(-40.0))
    rows = model.with_ratio(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), HOLD_OUT) == HELD, F.lit(False)).alias("held_out"), (1 / (1 + F.exp(-curve))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
