"""Periodic runs against a scan of every start and period."""

import hashlib
import random
import re
import zlib

import messy
import numpy as np
import pytest

from forecastops.llm import periodic_runs as p

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(part):
    return next(q for q in range(1, len(part) + 1) if all(part[i] == part[i + q] for i in range(len(part) - q)))


def brute(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and smallest_period(words[i:i + length]) == q:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    q = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]


def report(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def cases():
    rng = random.Random(5)
    for k in range(300):
        size = rng.choice([1, 2, 3, 5, 30])
        words = [rng.randrange(size) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            q, at = rng.randrange(1, 60), rng.randrange(len(words) + 1)
            block = [rng.randrange(rng.choice([1, 2, 50])) for _ in range(q)]
            words[at:at] = (block * 5)[:rng.randrange(q, 4 * q + 1)]
        yield words
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    yield b  # many nested periods
    yield [bin(i).count("1") % 2 for i in range(400)]
    yield [7] * 500
    yield (list(range(40)) * 2 + [99]) * 4
    yield list(range(100)) + list(range(100))
    yield list(range(100)) + list(range(99))


@pytest.mark.parametrize("words", list(cases()), ids=str)
def test_runs_match_brute_force(words):
    assert p.runs_of(np.array(words, np.int64)) == brute(words)


def test_segments_hold_only_words_found_twice():
    rng = random.Random(1)
    for size in (3, 40, 150):
        ids = np.array([rng.randrange(size) for _ in range(300)])
        parts = p.segments(ids)
        assert all(np.unique(ids[b:e], return_counts=True)[1].min() > 1 for b, e in parts)
        for start, length, _ in brute(ids.tolist()):
            assert any(b <= start and start + length <= e for b, e in parts)


def test_long_texts_stay_cheap():
    for words in (["same"] * 400_000, ["a", "b", "c"] * 100_000, [str(i % 1000) for i in range(300_000)], [str(i * i % 9973 % 50) for i in range(300_000)]):
        runs, text = p.text_runs(" ".join(words))
        assert len(runs) >= 1 and len(text) < 40_000


def test_query_columns_match_brute_force(spark):
    extra = [(k, messy.prose(k, 40 + k, 6) + " and\tthen\n" + messy.prose(k, 9, 2), "x", "y", 1, 0.5, "x", "y", "z") for k in range(20, 80)]
    rows = messy.rows() + extra
    docs = spark.createDataFrame(rows, messy.SCHEMA).repartition(3)
    found = p.periodic_runs(docs.withColumn("text", p.planted_text(docs.doc_id, docs.text)))
    got = sorted((tuple(r) for r in p.run_report(found).collect()), key=str)
    assert got == sorted((report(r[0], r[1]) for r in rows), key=str)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[0] is not None for r in rows) > 3


def test_empty_table_and_clashing_columns(spark):
    assert p.run_report(p.periodic_runs(messy.empty(spark))).count() == 0
    docs = messy.documents(spark).withColumnsRenamed({"line": "runs", "words": "collapsed", "H": "found"})
    assert p.run_report(p.periodic_runs(docs)).count() == len(messy.rows())
