"""Winnowing against a scan of every window, and its match guarantee."""

import hashlib
import random

import messy
import pytest
import regex

from forecastops.llm import winnowing as w

PIECES = regex.compile(r"\p{Ideographic}|[^ \t\n\x0b\x0c\r\p{Ideographic}]{1,16}")


def marks_of(grams, window):
    """Positions chosen by winnowing of a list of hashes."""
    chosen = set()
    for begin in range(max(1, len(grams) - window + 1) if grams else 0):
        part = grams[begin:begin + window]
        chosen.add(begin + max(i for i, h in enumerate(part) if h == min(part)))
    return sorted(chosen)


@pytest.mark.parametrize("gram,window", [(1, 1), (1, 4), (3, 5), (4, 8), (5, 1), (7, 6)])
def test_marks_are_the_least_of_their_windows(spark, gram, window):
    rng = random.Random(gram)
    texts = [messy.prose(k, rng.randrange(60), 4) for k in range(30)] + ["漢字かな交じり文 " * 4, "x" * 100, "a\tb\nc 漢d", "", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    single = {r["doc_id"]: r["marks"] for r in w.fingerprints(docs, gram, 1).collect()}  # windows of one: all hashes
    for r in w.fingerprints(docs, gram, window).collect():
        grams = [m["hash"] for m in single[r["doc_id"]]]
        pieces = PIECES.findall(texts[r["doc_id"]] or "")
        assert len(grams) == (max(1, len(pieces) - gram + 1) if pieces else 0)
        spans = [tuple(pieces[i:i + gram]) for i in range(len(grams))]
        assert len(set(spans)) == len(set(grams)) == len(set(zip(spans, grams)))  # a hash stands for its gram
        assert [m["position"] for m in r["marks"]] == marks_of(grams, window)
        assert [m["hash"] for m in r["marks"]] == [grams[p] for p in marks_of(grams, window)]


def test_shared_passages_give_common_marks(spark):
    passage = messy.prose(1, w.GRAM + w.WINDOW - 1, 10**6)
    docs = spark.createDataFrame([(k, f"{messy.prose(100 + k, 20 + 7 * k, 10**6)} {passage} {messy.prose(200 + k, 30, 10**6)}") for k in range(8)], "doc_id long, text string")
    found = [{m["hash"] for m in r["marks"]} for r in w.fingerprints(docs).collect()]
    assert all(a & b for a in found for b in found)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(spark, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'-' if r[0] is None else r[0]}|{r[1]}".encode()).digest())
    ordered = sorted([(i, t or "") for i, t in rows], key=key)
    out = []
    for k, (i, text) in enumerate(ordered):
        follow = ordered[(k + 1) % len(ordered)][1]
        lost = len(text) // 4
        out.append((i, text, text[:len(text) - lost] + follow[:lost], follow))
    texts = sorted({t for r in out for t in r[1:]})
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = {texts[r["doc_id"]]: r["marks"] for r in w.fingerprints(table).collect()}
    digest = lambda t: hashlib.sha256(",".join(f"{m['hash']}@{m['position']}" for m in marks[t]).encode()).hexdigest()
    sets = {t: {m["hash"] for m in found} for t, found in marks.items()}
    return sorted([(i, len(t), hashlib.sha256(e.encode()).hexdigest(), digest(t), digest(e), jaccard(sets[t], sets[e]), jaccard(sets[t], sets[n]), len(marks[t])) for i, t, e, n in out], key=str)


def test_report_matches_brute_force(spark):
    rows = messy.rows() + [(k % 7 + 30, messy.prose(k % 5, 30 + k % 5), "x", "y", 1, 0.5, "x", "y", "z") for k in range(40)]
    docs = spark.createDataFrame(rows, messy.SCHEMA).repartition(5)
    docs = docs.withColumnsRenamed({"line": "row", "words": "marks", "H": "own"})
    got = sorted((tuple(r) for r in w.fingerprint_report(w.beside_next(docs)).collect()), key=str)
    assert got == expected(spark, [r[:2] for r in rows])


def test_equal_texts_one_row_and_empty_table(spark):
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    r = w.fingerprint_report(w.beside_next(one)).collect()[0]
    assert r["near_next"] == 1.0 and r["n_chars"] == 13
    assert w.fingerprint_report(w.beside_next(messy.empty(spark))).count() == 0
