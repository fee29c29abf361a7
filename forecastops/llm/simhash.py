"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code on 64 bits: the direct sum of two binary Golay codes (23 bits, radius 3),
a Hamming code (15 bits, radius 1) and the repetition code of 3 bits (radius 1). All four are perfect, so every
fingerprint has exactly one anchor within the radius of each part. Two fingerprints that differ in at most two bits
have a midpoint one bit from either; the midpoint's anchor lies within the radius, plus one in one part, of both.
Replicating every fingerprint to all anchors that near (the covering radius plus the share of the threshold that
falls to its side; about 17 of 2**36 anchors) therefore brings every linked pair together at some anchor.

Documents are first reduced to distinct fingerprints. Anchors with few fingerprints compare theirs in one task and
give a spanning forest of the links, not all pairs. Fingerprints of fuller anchors are replicated once more, to the
65 points within one bit (the code of radius 0): whoever meets there is linked, at most 65 meet, and each is linked
with the smallest. Both ways are exact.

Defined results: null and blank texts have fingerprint 0 and link like any other; repeated rows share a component;
null ids never name a component unless nothing else is in it; texts are used whole; an empty table gives an empty
table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from forecastops.llm.common import plain_text, shared_rows

SEED = 42
SHINGLE = 3
MAX_DIFFERENCE = 2
ANCHOR_ROWS = 64
GOLAY_POLYNOMIAL, HAMMING_POLYNOMIAL = 0b110001110101, 0b10011  # generators of the cyclic Golay and Hamming codes


def fingerprint_of(text: str) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the hashes of the 3-word shingles."""
    found = text.encode().lower().split()  # bytes: only A-Z are lowered, only the six ASCII blanks split
    if not found:
        return 0
    if len(found) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    begins, ends = (ends - sizes)[:len(found) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    n, counts = len(begins), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.fromiter((digest(view[a:b], SEED) for a, b in zip(begins[at:at + (1 << 16)], ends[at:at + (1 << 16)])), np.uint64)
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text as a signed 64-bit number."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return run(plain_text(text))


class _Part:
    """One cyclic perfect code on ``bits`` bits from ``shift``: error patterns of each syndrome by weight."""

    def __init__(self, shift: int, bits: int, radius: int, polynomial: int | None):
        self.shift, self.mask = np.uint64(shift), np.uint64((1 << bits) - 1)
        self.bits, self.polynomial = bits, polynomial
        near: dict[int, int] = {}
        next_out: dict[int, list[int]] = {}
        for weight in range(radius + 2):
            for places in combinations(range(bits), weight):
                error = sum(1 << p for p in places)
                syndrome = self._syndrome(error)
                if weight <= radius:
                    near[syndrome] = error
                else:
                    next_out.setdefault(syndrome, []).append(error)
        width = max(map(len, next_out.values()))
        self.near = np.array([near[s] for s in range(len(near))], np.uint64)
        self.more = np.zeros((len(near), width), np.uint64)  # 0 pads: no pattern of this weight
        for s, errors in next_out.items():
            self.more[s, :len(errors)] = errors
        self.low = np.array([self._syndrome(v) for v in range(1 << min(bits, 12))], np.uint64)
        self.high = np.array([self._syndrome(v << 12) for v in range(1 << max(0, bits - 12))], np.uint64)

    def _syndrome(self, value: int) -> int:
        if self.polynomial is None:  # repetition code: differences of neighbours
            return (value ^ value >> 1) & ((1 << self.bits - 1) - 1)
        size = self.polynomial.bit_length()
        for k in range(self.bits - size, -1, -1):
            if value >> k + size - 1 & 1:
                value ^= self.polynomial << k
        return value

    def errors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every word, the pattern to its nearest codeword and those to the next, in place."""
        own = words >> self.shift & self.mask
        syndrome = self.low[own & np.uint64(0xFFF)] ^ self.high[own >> np.uint64(12)]
        return self.near[syndrome] << self.shift, self.more[syndrome] << self.shift


def _parts() -> list[_Part]:
    return [_Part(0, 23, 3, GOLAY_POLYNOMIAL), _Part(23, 23, 3, GOLAY_POLYNOMIAL), _Part(46, 15, 1, HAMMING_POLYNOMIAL), _Part(61, 3, 1, None)]


def anchors_of(fingerprints: np.ndarray, parts: list[_Part]) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within the radius, plus one in one part, of each fingerprint; and the fingerprints' positions."""
    found = [p.errors(fingerprints) for p in parts]
    home = fingerprints.copy()
    for near, _ in found:
        home ^= near
    anchors, places = [home], [np.arange(len(home))]
    for near, more in found:
        row, column = np.nonzero(more)
        anchors.append(home[row] ^ near[row] ^ more[row, column])
        places.append(row)
    return np.concatenate(anchors), np.concatenate(places)


def replicate(fingerprints: DataFrame) -> DataFrame:
    """``(anchor, fp)`` for every anchor near enough to each ``fp``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = _parts()
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64).view(np.uint64)
            anchors, places = anchors_of(values, parts)
            yield pd.DataFrame({"anchor": anchors.view(np.int64), "fp": values[places].view(np.int64)})

    return fingerprints.select("fp").mapInPandas(run, "anchor long, fp long")


def _forest(anchor: np.ndarray, fp: np.ndarray, reach: int) -> pd.DataFrame:
    """Links that join what is linked within each anchor; rows are ordered by anchor."""
    bits = fp.view(np.uint64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for gap in range(1, reach):
        same = np.nonzero(anchor[gap:] == anchor[:-gap])[0]
        if not len(same):
            break
        for i in same[np.bitwise_count(bits[same] ^ bits[same + gap]) <= MAX_DIFFERENCE].tolist():
            a, b = root(i), root(i + gap)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((fp[i], fp[i + gap]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _compare(rows: DataFrame, limit: int) -> DataFrame:
    """Links within each anchor of at most ``limit`` rows; ``rows`` come ordered by anchor."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            anchor = np.concatenate([anchor, batch["anchor"].to_numpy(np.int64)])
            fp = np.concatenate([fp, batch["fp"].to_numpy(np.int64)])
            whole = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last anchor may go on
            yield _forest(anchor[:whole], fp[:whole], limit)
            anchor, fp = anchor[whole:], fp[whole:]
        yield _forest(anchor, fp, limit)

    return rows.select("anchor", "fp").mapInPandas(run, "a long, b long")


def links(fingerprints: DataFrame, limit: int = ANCHOR_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect what fingerprints differing in at most two bits connect."""
    group = Window.partitionBy("anchor")
    rows = replicate(fingerprints).withColumn("n", F.count("*").over(group)).where(F.col("n") > 1)
    rows = shared_rows(rows.sortWithinPartitions("anchor"))
    few = rows.where(F.col("n") <= limit).repartition("anchor").sortWithinPartitions("anchor", "fp")
    full = rows.where(F.col("n") > limit).select("fp").distinct()
    points = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    meet = full.select("fp", F.explode(points).alias("point"))
    meet = meet.withColumn("b", F.min("fp").over(Window.partitionBy("point"))).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return _compare(few, limit).unionByName(meet).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of an edge table ``(a, b)``; nodes are connected if their roots agree.

    Each round maps every node to the neighbour (or itself) that comes first in that round's random order and
    contracts the edges, so the number of nodes falls by a constant factor. All tables stay distributed.
    """
    edges = shared_rows(edges.where(F.col("a") != F.col("b")))
    maps = []
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        parent = shared_rows(first.select(F.col("a").alias("node"), F.least("best", rank("a"))["v"].alias("up")))
        maps.append(parent)
        up = lambda c: parent.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))
        moved = edges.join(up("a"), "a").join(up("b"), "b").where(F.col("up_a") != F.col("up_b"))
        edges = shared_rows(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("up").alias("root"))
    for parent in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("up"), "root")
        roots = parent.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return roots


def fingerprint_roots(owners: DataFrame) -> DataFrame:
    """``owners`` (one row for each ``fp``) with ``root``: the same for fingerprints that links connect."""
    roots = shared_rows(components(links(owners)))
    return owners.join(roots, owners["fp"] == roots["node"], "left").select(*[owners[c] for c in owners.columns], F.coalesce("root", owners["fp"]).alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (signed) and ``component_id`` (smallest id reachable) of every row."""
    rows = shared_rows(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    linked = fingerprint_roots(shared_rows(rows.groupBy("fp").agg(F.min("doc_id").alias("first"))))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``: that of the smallest id, then text hash.

    Rows without an id cannot be told apart by it and all stay. Of rows with equal id and text one stays. Only ids,
    hashes and fingerprints are grouped; then each text travels once.
    """
    key = F.unhex(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), plain_text(F.col("text"))).cast("binary")))
    rows = shared_rows(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", key.alias("key"), fingerprint(F.col("text")).alias("fp")))
    # The smallest key of every fingerprint first: a group of copies is one row from here on.
    owners = rows.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("first"))
    chosen = fingerprint_roots(shared_rows(owners)).groupBy("root").agg(F.min("first").alias("first")).where(F.col("first").isNotNull())
    chosen = chosen.select(F.col("first.key").alias("kept"))
    named = rows.where(F.col("doc_id").isNotNull()).join(chosen, F.col("key") == F.col("kept"), "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return named.select("row.*").unionByName(rows.where(F.col("doc_id").isNull()).select("row.*"))
