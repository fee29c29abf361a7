import random

import messy
import numpy as np

from forecastops.llm import decontaminate as d


def scores(spark, docs, items, **options):
    frames = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in d.contamination(*frames, **options).collect()}


def edited(words, rng, share):
    out = []
    for w in words:
        kind = rng.random()
        if kind < share / 3:
            continue
        out.append("edit" if kind < 2 * share / 3 else w)
        if kind > 1 - share / 3:
            out.append("more")
    return out


def test_same_pairs_and_scores_as_aligning_everything(spark):
    rng = random.Random(5)
    items = [(k, messy.prose(100 + k, 12 + 3 * k, 3000), "x") for k in range(8)] + [(8, "two words", "x"), (9, None, "x"), (10, "?!", "x"), (11, messy.prose(100, 12, 3000), "x")]
    docs = []
    for k in range(60):
        words = messy.prose(k, 150, 3000).split()
        if k % 2:
            at = rng.randrange(150)
            words[at:at] = edited(items[k % 8][1].split(), rng, rng.choice([0, 0.1, 0.2, 0.3]))
        docs.append((k, " ".join(words).upper() + ".", "x"))
    docs += [(60, None, "x"), (61, "", "x"), (62, "has two words inside", "x"), (None, items[0][1], "x")]
    got = scores(spark, docs, items)
    block = d.ItemBlock([(i, t or "") for i, t, _ in items], d.SEED_WORDS, d.SEED_WINDOW)
    expected, sure = {}, set()
    run = d.SEED_WORDS + d.SEED_WINDOW - 1
    for doc_id, text, _ in docs:
        ids = block.encode(text or "")
        for item, own in zip(block.items, block.ids):
            score = d.align(own, ids)[0] / len(own)
            if score >= d.MIN_SCORE:
                expected[doc_id, item] = round(score, 9)
                held = {tuple(ids[k:k + run]) for k in range(len(ids) - run + 1)}
                if len(own) < run or any(tuple(own[k:k + run]) in held for k in range(len(own) - run + 1)):
                    sure.add((doc_id, item))
    assert got.items() <= expected.items() and sure <= set(got)  # found for certain: what shares so many words in a row
    assert len(sure) >= 25 and len(got) >= 0.95 * len(expected)
    assert scores(spark, docs, items, block_bytes=200) == got  # several blocks


def test_alignment_against_plain_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(1, 5, rng.integers(1, 9)), rng.integers(0, 5, rng.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, first, last = d.align(a, b)
        assert score == h.max()
        assert score == 0 or d.align(a, b[first:last + 1])[0] == score


def test_a_passage_in_most_documents_is_still_found(spark):
    passage = messy.prose(7, 30, 3000)
    docs = [(k, messy.prose(1000 + k, 50, 3000) + " " + passage, "x") for k in range(200)]
    assert len(scores(spark, docs, [(1, passage, "x")])) == 200


def test_empty_and_messy_tables(spark):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7")], "item_id long, text string")
    assert d.contamination(messy.empty(spark), items).count() == 0
    assert d.contamination(messy.documents(spark), items.limit(0)).count() == 0
    kept = d.clean_documents(messy.documents(spark), items)
    assert kept.count() == len(messy.rows()) and kept.columns == messy.documents(spark).columns
