"""Periodic runs of words, found by recursive frequency splitting and lag scans.

A run is a stretch of at least ``max(MIN_LENGTH, 2 * period)`` words that repeats with its smallest period and cannot be
extended. Every word of a run occurs at least twice in it, so a word that occurs once within the current segment belongs
to no run there: it splits the segment. The parts are split again until nothing changes, and only segments that can
still hold a run are scanned, at lags up to half their length.

Short lags (below ``ALL_LAGS``) are scanned in full. Longer lags are taken scale by scale: words of a run of period ``q``
agree with those ``q`` later over at least ``q`` positions, so for ``q`` from ``Q`` to ``2 Q`` one of the aligned blocks of
``Q / 2`` words has an equal block ``q`` later. Blocks are compared by a hash of their words; a lag and block found so are
scanned in both directions on the words themselves, so the hash decides nothing. Blocks well inside a run of a period of
at most half the scale are skipped: another run there would have that run's period. Work per text is about
``n log n`` for ``n`` words, also where the whole text is one run, and memory is a few arrays of ``n`` numbers.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; a text must fit in a
row and is used whole; rows are judged one by one, repeated rows alike; an empty table gives an empty table. Only ``doc_id`` and the text
column are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.llm.common import plain_text, words

MIN_LENGTH = 12
ALL_LAGS = 16
RESULT = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the previous and of the next occurrence of each word; -1 and ``len(ids)`` where there is none."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def segments(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """Maximal segments in which every word occurs at least twice, in order.

    After a split all positions of the smaller parts are looked at again, but of the largest part only those whose
    neighbours lie in the others, so the whole recursion takes ``n log n`` steps.
    """
    before, after = neighbours(ids)
    out, stack = [], [(0, len(ids), np.arange(len(ids)))]
    while stack:
        begin, end, check = stack.pop()
        rare = check[(before[check] < begin) & (after[check] >= end)]
        if not len(rare):
            out.append((begin, end))
            continue
        cuts = np.unique(rare)
        begins, ends = np.concatenate([[begin], cuts + 1]), np.concatenate([cuts, [end]])
        largest = int(np.argmax(ends - begins))
        for k in np.nonzero(ends - begins >= min_length)[0].tolist():
            low, high = int(begins[k]), int(ends[k])
            if k == largest:
                near = np.concatenate([after[begin:low], before[high:end]])
                stack.append((low, high, near[(near >= low) & (near < high)]))
            else:
                stack.append((low, high, np.arange(low, high)))
    return sorted(out)


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of every stretch of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist()))


def _equal_for(words: np.ndarray, begin: int, lag: int, forward: bool) -> int:
    """From ``begin`` (``begin - 1`` backwards) on, for how many positions the words ``lag`` later are the same."""
    done, step = 0, 64
    while True:
        if forward:
            size = min(step, len(words) - lag - begin - done)
            low = begin + done
            differs = np.flatnonzero(words[low:low + size] != words[low + lag:low + lag + size])
            first = int(differs[0]) if len(differs) else size
        else:
            size = min(step, begin - done)
            high = begin - done
            differs = np.flatnonzero(words[high - size:high] != words[high - size + lag:high + lag])
            first = size - 1 - int(differs[-1]) if len(differs) else size
        done += first
        if first < step:
            return done
        step *= 2


def _prime_factors(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return out + ([n] if n > 1 else [])


def _smallest(words: np.ndarray, begin: int, length: int, period: int) -> bool:
    """Whether a stretch of at least two periods has no smaller one: any smaller one would divide it."""
    part = words[begin:begin + length]
    return not any((part[:-d] == part[d:]).all() for d in (period // f for f in _prime_factors(period)))


def _block_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; sums of mixed words times powers, differences of prefix sums."""
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, _MULTIPLIER)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[::-1], dtype=np.uint64)])
        return (sums[size:] - sums[:-size]) * powers[:len(words) - size + 1]


def _candidates(words: np.ndarray, scale: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(lag, position) pairs worth a scan, for lags from ``scale`` to twice that, by lag and position."""
    size = scale // 2
    hashes = _block_hashes(words, size)
    anchors = np.arange(0, len(hashes), size)
    order = np.lexsort((np.arange(len(hashes)), hashes))
    ranked = hashes[order]
    # Equal hashes are neighbours in the sorted order, and there positions ascend.
    group = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    rank_of = np.empty(len(hashes), np.int64)
    rank_of[order] = np.arange(len(hashes))
    keys = group * (len(words) + 1) + order
    own = group[rank_of[anchors]] * (len(words) + 1)
    low = np.searchsorted(keys, own + np.minimum(anchors + scale, len(words)))
    high = np.searchsorted(keys, own + np.minimum(anchors + 2 * scale, len(words)))
    counts = high - low
    at = np.repeat(anchors, counts)
    place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    lag = order[place] - at
    reach = np.zeros(len(words), np.int64)
    for begin, length, period in found:
        if period <= size:
            reach[begin] = max(reach[begin], begin + length)
    inside = np.maximum.accumulate(reach)[at] >= at + lag + size
    at, lag = at[~inside], lag[~inside]
    order = np.lexsort((at, lag))
    return list(zip(lag[order].tolist(), at[order].tolist()))


def runs_of_segment(words: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a segment."""
    n, found = len(words), []
    for lag in range(1, min(ALL_LAGS - 1, n // 2) + 1):
        for begin, end in _stretches(words[:-lag] == words[lag:], max(min_length - lag, lag)):
            if _smallest(words, begin, end - begin + lag, lag):
                found.append((begin, end - begin + lag, lag))
    scale = ALL_LAGS
    while scale <= n // 2:
        lag_before, reached = 0, -1
        for lag, at in _candidates(words, scale, found):
            if lag == lag_before and at < reached or 2 * lag > n:
                continue
            if lag != lag_before:
                lag_before, reached = lag, -1
            begin = at - _equal_for(words, at, lag, False)
            end = at + _equal_for(words, at, lag, True)
            reached = max(reached, end)
            length = end - begin + lag
            if length >= max(min_length, 2 * lag) and _smallest(words, begin, length, lag):
                found.append((begin, length, lag))
        scale *= 2
    return found


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text given as word numbers, by start and period."""
    if len(ids) < min_length:
        return []
    out = []
    for begin, end in segments(ids, min_length):
        out += [(begin + start, length, period) for start, length, period in runs_of_segment(ids[begin:end], min_length)]
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapse(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, without those that lie in a run after its first period."""
    if not runs:
        return b" ".join(found)
    change = np.zeros(len(found) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, k in zip(found, kept.tolist()) if k])


def text_runs(text: str) -> tuple[list[tuple[int, int, int]], str]:
    """Runs and collapsed text of one text."""
    found = text.encode().split()  # of bytes, the six ASCII blanks alone split
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, found, range(len(found))), np.int64, len(found))
    runs = runs_of(ids)
    return runs, collapse(found, runs).decode()


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``runs`` (start, length and period in words, by start and period) and ``collapsed`` of every row."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triple = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        for batch in batches:
            rows = [text_runs(t) for t in batch.column(1).to_pylist()]
            flat = np.array([r for runs, _ in rows for r in runs], np.int64).reshape(-1, 3)
            ends = np.cumsum([0] + [len(runs) for runs, _ in rows])
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(triple))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), pa.array([c for _, c in rows], pa.string())],
                names=["doc_id", "runs", "collapsed"])

    rows = docs.select("doc_id", plain_text(F.col(text)).alias("text"))
    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text; of every tenth document by hash, one whose words repeat from some place on.

    With ``h`` the ``crc32`` of the id's decimal text and ``g = h div 10``: where ``h mod 10`` is 0, word ``i >= a`` becomes
    word ``a + (i - a) mod p``, for ``a = g mod n`` and ``p = 1 + (n - a) div (3 + g mod 8)``. Without an id: the text.
    """
    h, own = F.crc32(doc_id.cast("string").cast("binary")), words(text)
    n = F.size(own).cast("long")

    def repeated(parts):
        g, n = parts["g"], parts["n"]
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(parts["w"], lambda w, i: F.get(parts["w"], place(i))), " ")

    parts = F.struct(own.alias("w"), n.alias("n"), F.floor(h / 10).alias("g"))
    planted = F.get(F.transform(F.array(parts), repeated), F.lit(0))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), planted).otherwise(plain_text(text))


def run_report(found: DataFrame) -> DataFrame:
    """Number of runs, the longest run, and hashes of all runs and of the collapsed text, of every row of ``periodic_runs``."""
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(spelled.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
