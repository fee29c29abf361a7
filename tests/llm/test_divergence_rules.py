import math
import re
from collections import Counter

import messy
import pytest

from forecastops.llm import divergence_rules as d

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def distance(a, b):
    a, b = [x / sum(a) for x in a], [x / sum(b) for x in b]
    part = lambda x, m: x * math.log2(x / m) if x else 0
    return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(a, b)) / 2))


def test_base_counts_match_brute_force(spark):
    got = d.judge(messy.documents(spark)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(r["doc_id"], *[r[c] for c in columns]) for r in got], key=str) == sorted([(r[0], *base(r[1])) for r in messy.rows()], key=str)


def test_distances_match_brute_force(spark):
    docs = [(k, messy.prose(k, 60 + k, 30), "en" if k % 2 else "de") for k in range(30)] + [(30, "ABC DEF!! " * 40 + messy.prose(90, 60, 300), "en"), (31, messy.prose(3, 80, 30), None)]
    got = {r["doc_id"]: r for r in d.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), common=5).collect()}
    hist = lambda words, common: [words.count(c) for c in common] + [sum(w not in common for w in words)]
    for language in ("en", "de", ""):
        own = [(i, t) for i, t, lang in docs if (lang or "") == language]
        frequency = Counter(w for _, t, lang in docs if not language or lang == language for w in set(t.split()))
        common = [w for w, _ in sorted(frequency.items(), key=lambda x: (-x[1], x[0]))[:5]]
        good = [t for i, t in own if not got[i]["base_failed"]]
        reference = [sum(x) for x in zip(*[hist(t.split(), common) for t in good])]
        for i, t in own:
            assert got[i]["word_distance"] == pytest.approx(distance(hist(t.split(), common), reference), abs=1e-9)
    assert not got[30]["kept"] and sum(got[k]["kept"] for k in range(30)) >= 27


def test_more_languages_than_the_limit_and_empty(spark):
    docs = spark.createDataFrame([(k, messy.prose(k, 80, 60), f"l{k % 7}") for k in range(70)], "doc_id long, text string, lang string")
    got = d.judge(docs, max_languages=2).collect()
    assert len(got) == 70 and all(r["word_distance"] is not None for r in got)
    assert d.judge(messy.empty(spark)).count() == 0


def test_unknown_and_rare_languages_are_compared_with_all_documents(spark):
    clean = [(k, messy.prose(k, 100, 60), ["en", "de"][k % 2]) for k in range(60)]
    junk = "#$% ### |<> $$$ *** &&& %%% <<< >>> |||"
    odd = [(150 + k, " ".join(f"{junk}{k}{j} {messy.prose(k * 9 + j, 12, 400)}" for j in range(8)), None) for k in range(4)]
    rare = [(170, odd[0][1] + " ###7", "xx"), (71, messy.prose(71, 100, 60), "yy"), (72, messy.prose(72, 100, 60), None), (73, messy.prose(73, 100, 60), "")]
    docs = clean + odd + rare
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in d.judge(frame, common=5, max_languages=None, pool_unknown=True, min_reference_words=500).collect()}
    hist = lambda words, common: [words.count(c) for c in common] + [sum(w not in common for w in words)]

    def top(rows):
        frequency = Counter(w for t in rows for w in set(t.split()))
        return [w for w, _ in sorted(frequency.items(), key=lambda x: (-x[1], x[0]))[:5]]

    for i, t, lang in docs:
        own = [u for _, u, other in docs if lang not in ("en", "de") or other == lang]
        common = top(own)
        good = [u for j, u, other in docs if (lang not in ("en", "de") or other == lang) and not got[j]["base_failed"]]
        reference = [sum(x) for x in zip(*[hist(u.split(), common) for u in good])]
        assert got[i]["word_distance"] == pytest.approx(distance(hist(t.split(), common), reference), abs=1e-9), i
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i, *_ in odd) and not got[170]["kept"]
    assert got[71]["kept"] and got[72]["kept"] and got[73]["kept"]


def test_pooled_reference_of_awkward_rows(spark):
    got = d.judge(messy.documents(spark), pool_unknown=True, max_languages=None).collect()
    assert len(got) == len(messy.rows())
    assert d.judge(messy.empty(spark), pool_unknown=True, max_languages=None).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "en")], "doc_id long, text string, lang string")
    assert [r["kept"] for r in d.judge(blank, pool_unknown=True).collect()] == [False, False]
