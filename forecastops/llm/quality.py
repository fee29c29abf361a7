"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and adds a small tree over that feature's bins to its lookup table;
then it visits the pairs of features that explain most of what is left. A document's score is the logistic function
of the sum of its table entries, added for a whole batch at once.

Features describe a text alone. The fit uses at most ``max_rows`` labelled rows, the first in the order of a hash of
the id, with their features gathered on the driver; scoring reads every text whole.

Defined results: null and empty texts have all features 0 and a score like any other; labels that are null or whose
document is missing are left out; a document with several labels counts once for each; without any labelled row every
score is 0.5, and with one class the scores follow its share; repeated rows get equal scores; an empty table gives an
empty table. Only ``doc_id`` and ``text`` of documents and the label column are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.llm.common import fold, plain_text

MAX_ROWS = 20_000
HOLD_OUT = 5
THRESHOLD = 0.3
FEATURES = ("words", "word_length", "long_word", "distinct", "repeat_next", "repeat_window", "upper", "digit", "mark", "symbol", "bar_word",
            "line_words", "repeat_line", "first_upper", "wide")


def _byte_classes() -> np.ndarray:
    """Class of each byte: 0 lower letters, 1 upper, 2 digits, 3 marks of prose, 4 symbols, 5 blanks, 6 other scripts."""
    table = np.full(256, 4, np.uint8)
    table[0x61:0x7B], table[0x41:0x5B], table[0x30:0x3A], table[0x80:] = 0, 1, 2, 6
    table[[ord(c) for c in ".,;:!?'\"()-"]] = 3
    table[[0x20, *range(0x09, 0x0E)]] = 5
    return table


_CLASSES = _byte_classes()


def text_features(text: str) -> list[float]:
    """``FEATURES`` of one text."""
    data = text.encode()
    found = data.split()
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=7)
    chars = max(1, len(data) - int(counts[5]))
    windows = max(1, n - 2)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        float(np.log1p(n)), chars / n, max(map(len, found)) / 100.0, len(set(found)) / n,
        sum(a == b for a, b in zip(found, found[1:])) / n, 1.0 - len(set(zip(found, found[1:], found[2:]))) / windows if n > 2 else 0.0,
        counts[1] / chars, counts[2] / chars, counts[3] / chars, counts[4] / chars, found.count(b"|") / n,
        float(np.log1p(n / len(lines))), 1.0 - len(set(lines)) / len(lines), sum(w[:1].isupper() for w in found) / n, counts[6] / chars]


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts])

    return run(plain_text(text))


def _leaf(grad: np.ndarray, weight: np.ndarray, ridge: float) -> float:
    return grad.sum() / (weight.sum() + ridge)


def _gain(grad: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    return grad * grad / (weight + ridge)


class AdditiveModel:
    """Lookup tables for single features and pairs; ``fit`` on features and 0/1 labels, ``score`` in 0..1."""

    def __init__(self, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 3,
                 ridge: float = 5.0):
        self.bins, self.rounds, self.pair_count, self.pair_rounds = bins, rounds, pairs, pair_rounds
        self.rate, self.leaves, self.ridge = rate, leaves, ridge
        self.intercept, self.edges, self.tables = 0.0, [], []
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def _tree(self, grad: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Values of a tree with few leaves over ordered bins: the best split of any leaf, again and again."""
        parts = [(0, len(grad))]
        while len(parts) < self.leaves:
            best = None
            for low, high in parts:
                g, w = np.cumsum(grad[low:high]), np.cumsum(weight[low:high])
                if high - low < 2:
                    continue
                gain = _gain(g[:-1], w[:-1], self.ridge) + _gain(g[-1] - g[:-1], w[-1] - w[:-1], self.ridge) - _gain(g[-1], w[-1], self.ridge)
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], low, low + k + 1, high)
            if best is None:
                break
            parts.remove((best[1], best[3]))
            parts += [(best[1], best[2]), (best[2], best[3])]
        out = np.zeros(len(grad))
        for low, high in parts:
            out[low:high] = _leaf(grad[low:high], weight[low:high], self.ridge)
        return out

    def _pair_tree(self, grad: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        """Values over a grid cut once in one direction and each side once in the other; and the gain."""
        best_gain, best = -1.0, np.zeros_like(grad)
        whole = float(_gain(grad.sum(), weight.sum(), self.ridge))
        for turned in (False, True):
            g, w = (grad.T, weight.T) if turned else (grad, weight)
            up_g, up_w = np.cumsum(g, 0), np.cumsum(w, 0)
            sides = []
            for sg, sw in ((up_g[:-1], up_w[:-1]), (up_g[-1] - up_g[:-1], up_w[-1] - up_w[:-1])):
                cg, cw = np.cumsum(sg, 1), np.cumsum(sw, 1)
                gains = _gain(cg[:, :-1], cw[:, :-1], self.ridge) + _gain(cg[:, -1:] - cg[:, :-1], cw[:, -1:] - cw[:, :-1], self.ridge)
                sides.append((gains.max(1), gains.argmax(1)))
            total = sides[0][0] + sides[1][0] - whole
            cut = int(np.argmax(total))
            if total[cut] > best_gain:
                best_gain, values = float(total[cut]), np.zeros_like(g)
                for rows, (_, across) in zip((slice(0, cut + 1), slice(cut + 1, None)), sides):
                    k = int(across[cut]) + 1
                    for columns in (slice(0, k), slice(k, None)):
                        values[rows, columns] = _leaf(g[rows, columns], w[rows, columns], self.ridge)
                best = values.T if turned else values
        return best, best_gain

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        n, width = x.shape
        share = (y.sum() + 0.5) / (n + 1.0)
        self.intercept = float(np.log(share / (1 - share)))
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], cuts)) if n else np.zeros(0) for f in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        binned, logit = self._bin(x), np.full(n, self.intercept)
        if not 0 < y.sum() < n:
            return self

        def residual():
            p = 1 / (1 + np.exp(-logit))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                grad, weight = residual()
                step = self.rate * self._tree(np.bincount(binned[:, f], grad, len(table)), np.bincount(binned[:, f], weight, len(table)))
                table += step
                logit += step[binned[:, f]]
        grad, weight = residual()
        ranked = []
        for a, b in combinations(range(width), 2):
            _, gain = self._pair_tree(*self._grid(binned, a, b, grad, weight))
            ranked.append((-gain, a, b))
        self.pairs = [(a, b) for _, a, b in sorted(ranked)[:self.pair_count] if len(self.tables[a]) > 1 and len(self.tables[b]) > 1]
        self.grids = [np.zeros((len(self.tables[a]), len(self.tables[b]))) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for (a, b), grid in zip(self.pairs, self.grids):
                step = self.rate * self._pair_tree(*self._grid(binned, a, b, *residual()))[0]
                grid += step
                logit += step[binned[:, a], binned[:, b]]
        return self

    def _grid(self, binned, a, b, grad, weight):
        shape = (len(self.tables[a]), len(self.tables[b]))
        if min(shape) < 2:
            return np.zeros((2, 2)), np.zeros((2, 2))
        cell = binned[:, a] * shape[1] + binned[:, b]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (grad, weight))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.intercept)))
        binned = self._bin(x)
        logit = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            logit += table[binned[:, f]]
        for (a, b), grid in zip(self.pairs, self.grids):
            logit += grid[binned[:, a], binned[:, b]]
        return 1 / (1 + np.exp(-logit))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = HOLD_OUT, held: int = 0, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Model from the labelled documents outside the held-out fold."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull())
    marks = marks.where(fold(F.col("id"), parts) != held).orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(marks), "id").select("label", features(F.col("text")).alias("x")).collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["label"] > 0 for r in rows], float)
    order = np.lexsort([*x.T, y])  # sums in one order, whatever order the rows came in
    return AdditiveModel().fit(x[order], y[order])


def quality_score(text: Column, model: AdditiveModel) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return run(plain_text(text))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    model = train(docs, labels)
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), HOLD_OUT) == 0, F.lit(False)).alias("held_out"),
                       quality_score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored ``threshold`` or more, with all their columns."""
    return docs.where(quality_score(F.col("text"), train(docs, labels)) >= threshold)
