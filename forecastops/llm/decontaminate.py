"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size; each block is compared with all documents. The n-grams of its items
are counted over all documents. Of every ``window`` consecutive n-grams of an item the one in fewest documents is a
seed, so any ``n + window - 1`` consecutive words that a document shares with an item contain a seed, while n-grams
that many documents share are seeds only where nothing rarer is near. A document's seed hits name the items and
places to align, so hits, however many documents share a passage, never leave the document's task.

The local alignment is over words (+1 for a match, -1 for a mismatch or gap) and its score is divided by the item's
length: 1 is an exact copy, and a copy with a share ``e`` of its words replaced scores about ``1 - 2e``.

Words are lower-cased runs of letters and digits, so punctuation and case don't matter. Defined results: null and
empty texts have no words and match nothing; items without words are never matched; an item shorter than an n-gram
is its own seed; repeated documents are judged one by one, repeated items reported each; texts are read whole; empty
tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.llm.common import TOKEN, plain_text

SEED_WORDS = 3
SEED_WINDOW = 2
MIN_SCORE = 0.5
BLOCK_BYTES = 32 << 20
MATCHES = "array<struct<item_id:bigint,score:double,first:bigint,last:bigint,seeds:bigint>>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _codes(ids: np.ndarray, n: int) -> np.ndarray:
    """One number for each run of ``n`` word ids."""
    count = max(0, len(ids) - n + 1)
    code, step = np.zeros(count, np.uint64), _STEP
    with np.errstate(over="ignore"):
        for k in range(n):
            code = (code ^ ids[k:k + count].astype(np.uint64)) * step
            code ^= code >> np.uint64(29)
    return code


class ItemBlock:
    """The items of one block by word ids, and the n-grams that may seed them."""

    def __init__(self, items: list[tuple[int, str]], n: int, window: int):
        self.n, self.window = n, window
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            found = tokens(text or "")
            if found:
                self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
                self.items.append(item_id)
        self.bags = [np.unique(i, return_counts=True) for i in self.ids]
        # Seeds of items shorter than an n-gram are the whole item, so there is a table for each length in use.
        self.lengths = sorted({min(n, len(i)) for i in self.ids})
        self.grams = {k: np.unique(np.concatenate([_codes(i, k) for i in self.ids if min(n, len(i)) == k])) for k in self.lengths}

    def encode(self, text: str) -> np.ndarray:
        found = tokens(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))

    def _hits(self, ids: np.ndarray, k: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document's n-grams that are in the sorted table, and where in it."""
        known = ids > 0
        inside = known[:len(ids) - k + 1].copy()
        for j in range(1, k):
            inside &= known[j:len(ids) - k + 1 + j]
        places = np.nonzero(inside)[0]
        if not len(places):
            return places, places
        codes = _codes(ids, k)[places]
        at = np.searchsorted(table, codes)
        found = table[np.minimum(at, len(table) - 1)] == codes
        return places[found], at[found]

    def seen(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """For each length, which of the block's n-grams a document holds."""
        return {k: np.unique(self._hits(ids, k, self.grams[k])[1]) for k in self.lengths if len(ids) >= k}

    def choose_seeds(self, documents: dict[int, np.ndarray]) -> None:
        """Keep the rarest n-gram of every window; ``documents`` counts the documents that hold each n-gram."""
        self.seeds: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = {k: {} for k in self.lengths}
        for item, ids in enumerate(self.ids):
            k = min(self.n, len(ids))
            codes = _codes(ids, k)
            count = documents[k][np.searchsorted(self.grams[k], codes)]
            order = sorted(range(len(codes)), key=lambda i: (count[i], int(codes[i])))
            rank = np.empty(len(codes), np.int64)
            rank[order] = np.arange(len(codes))
            width = min(self.window, len(codes))
            best = {s + int(np.argmin(rank[s:s + width])) for s in range(len(codes) - width + 1)}
            for place in best:
                chosen[k].setdefault(int(codes[place]), []).append((item, place))
        for k, table in chosen.items():
            codes = np.array(sorted(table), np.uint64)
            self.seeds[k] = (codes, [table[int(c)] for c in codes])

    def _most(self, item: int, part: np.ndarray) -> int:
        """Words that an item and a part of a document have in common, in any order: no alignment scores more."""
        words, counts = self.bags[item]
        ordered = np.sort(part)
        held = np.searchsorted(ordered, words, side="right") - np.searchsorted(ordered, words, side="left")
        return int(np.minimum(counts, held).sum())

    def matches(self, text: str, min_score: float) -> list[tuple]:
        """(item_id, score, first word, last word, seeds) of the best alignment with each item found."""
        ids = self.encode(text)
        shifts: dict[int, list[int]] = {}
        for k, (table, where) in self.seeds.items():
            if len(ids) < k:
                continue
            places, at = self._hits(ids, k, table)
            for place, index in zip(places.tolist(), at.tolist()):
                for item, offset in where[index]:
                    shifts.setdefault(item, []).append(place - offset)
        out = []
        for item, found in shifts.items():
            length = len(self.ids[item])
            slack = length // 2 + 1
            found.sort()
            best, group = None, [found[0]]
            for shift in [*found[1:], None]:  # hits whose item would start near each other share an alignment
                if shift is not None and shift - group[-1] <= slack:
                    group.append(shift)
                    continue
                low, high = max(0, group[0] - slack), min(len(ids), group[-1] + length + slack)
                if self._most(item, ids[low:high]) >= min_score * length:
                    score, first, last = align(self.ids[item], ids[low:high])
                    if best is None or score / length > best[0]:
                        best = (score / length, low + first, low + last, len(group))
                group = [shift]
            if best is not None and best[0] >= min_score:
                out.append((int(self.items[item]), float(best[0]), int(best[1]), int(best[2]), int(best[3])))
        return sorted(out)


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two id sequences, and the first and last place of ``part`` it uses."""
    width = len(part)
    row, origin = np.zeros(width + 1, np.int64), np.arange(width + 1)
    best, steps = (0, 0, 0), np.arange(width + 1)
    for word in item.tolist():
        diagonal = row[:-1] + np.where(part == word, 1, -1)
        up = row[1:] - 1
        value = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        start = np.concatenate([[0], np.where(diagonal >= up, origin[:-1], origin[1:])])
        start = np.where(value > 0, start, steps)
        # A gap along the row costs 1 a step: the best earlier value, less the distance.
        lifted = value + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, steps, 0))
        row = top - steps
        origin = start[source]
        at = int(np.argmax(row))
        if row[at] > best[0]:
            best = (int(row[at]), int(origin[at]), at - 1)
    return best


def item_blocks(items: DataFrame, n: int = SEED_WORDS, window: int = SEED_WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemBlock]:
    """The items in blocks of about ``block_bytes``, each gathered on the driver in turn."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), plain_text(F.col("text")).alias("text")).where(F.col("text") != "")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // block_bytes)
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else rows
        found = part.orderBy("item_id", "text").collect()
        if found:
            block = ItemBlock([tuple(r) for r in found], n, window)
            if block.items:
                yield block


def count_documents(docs: DataFrame, block: ItemBlock) -> dict[int, np.ndarray]:
    """In how many documents each n-gram of the block is, over all documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {k: np.zeros(len(g), np.int64) for k, g in block.grams.items()}
        for batch in batches:
            for text in batch["text"]:
                for k, at in block.seen(block.encode(text)).items():
                    counts[k][at] += 1
        for k, values in counts.items():
            at = np.nonzero(values)[0]
            yield pd.DataFrame({"k": np.full(len(at), k, np.int64), "gram": at, "n": values[at]})

    found = docs.select(plain_text(F.col("text")).alias("text")).mapInPandas(run, "k long, gram long, n long")
    totals = {k: np.zeros(len(g), np.int64) for k, g in block.grams.items()}
    for k, gram, n in found.groupBy("k", "gram").agg(F.sum("n").alias("n")).collect():  # as many rows as the block has n-grams
        totals[k][gram] = n
    return totals


def find_matches(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, n: int = SEED_WORDS, window: int = SEED_WINDOW,
                 block_bytes: int = BLOCK_BYTES) -> list[Column]:
    """For each block of items, an expression over ``docs.text`` that lists the items a document matches."""
    def expression(block: ItemBlock) -> Column:
        @F.pandas_udf(MATCHES)
        def run(texts: pd.Series) -> pd.Series:
            names = ("item_id", "score", "first", "last", "seeds")
            return pd.Series([[dict(zip(names, m)) for m in block.matches(t, min_score)] for t in texts])

        return run(plain_text(F.col("text")))

    out = []
    for block in item_blocks(items, n, window, block_bytes):
        block.choose_seeds(count_documents(docs, block))
        out.append(expression(block))
    return out


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and item it holds: ``doc_id``, ``item_id``, ``score``, ``first``, ``last``, ``seeds``."""
    rows = docs.select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double, first bigint, last bigint, seeds bigint")
    for matches in find_matches(rows, items, **options):
        found = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), matches.alias("m")).select("doc_id", F.explode("m").alias("m"))
        out = out.unionByName(found.select("doc_id", "m.*"))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for matches in find_matches(docs, items, **options):
        docs = docs.where(F.size(matches) == 0)
    return docs
