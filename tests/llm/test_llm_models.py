"""Quality and toxicity: held-out accuracy, what must not matter, and edge cases."""

import messy
import numpy as np
import pytest
from pyspark.sql import functions as F

from forecastops.llm import quality, toxicity
from forecastops.llm.common import read

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "labels")


def held_out(scored, labels, column):
    rows = scored.where("held_out").join(labels.where(F.col(column).isNotNull()), "doc_id").select("score", "predicted", column).collect()
    return np.array([r["score"] for r in rows]), np.array([r["predicted"] for r in rows]), np.array([r[column] for r in rows])


def ranking(score, label):
    rank = score.argsort().argsort()
    ones = label == 1
    return (rank[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_quality_on_held_out_labels(spark, tables):
    scored = quality.score_documents(*tables).cache()
    score, predicted, label = held_out(scored, tables[1], "quality")
    assert ((score >= 0) & (score <= 1)).all() and ((score >= 0.3) == predicted).all()
    assert (predicted == label).mean() > 0.97 and ranking(score, label) > 0.97
    assert scored.count() == tables[0].count()


def test_quality_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert (0, 1) in model.pairs


def test_toxicity_on_held_out_labels(spark, tables):
    scored = toxicity.score_documents(*tables).cache()
    score, predicted, label = held_out(scored, tables[1], "toxic")
    assert ((score >= 0.7) == predicted).all()
    toxic, clean = predicted[label == 1], predicted[label == 0]
    assert toxic.mean() > 0.6 and clean.mean() < 0.01


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(k, ("bad words here " if k % 3 else "fine prose text ") + messy.prose(k, 40), "en", "s") for k in range(300)],
                                 "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    for module, parts, held, column in ((quality, 5, 0, "quality"), (toxicity, 3, 1, "toxic")):
        hidden = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held, 1 - F.col(column)).otherwise(F.col(column)))
        other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
        first = sorted(map(str, module.score_documents(docs, labels).collect()))
        assert first == sorted(map(str, module.score_documents(other.repartition(5), hidden).collect()))


def test_messy_documents_and_labels(spark):
    docs = messy.documents(spark)
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (3, 0, 1), (99, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        rows = module.score_documents(docs, labels).collect()
        assert len(rows) == len(messy.rows()) and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
        assert module.score_documents(messy.empty(spark), labels).count() == 0
        assert {r["score"] for r in module.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_toxic_words_behind_new_endings_are_recognised(spark):
    docs = [(k, ("scumlike%d " % (k % 40) if k % 2 else "") + messy.prose(k, 60)) for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert model.word_ratio("scumlikenever") > 1.0 and abs(model.word_ratio("neverseen")) < 1e-9
    assert model.score(np.array([model.mean_ratio("scumlikenever w1 w2 w3"), model.mean_ratio("w1 w2 w3"), model.mean_ratio("")]))[0] > 0.7


def test_toxic_word_order_is_seen(spark):
    """The same two words in another order: only what stands before a word tells the classes apart."""
    docs = [(k, f"{messy.prose(k, 12)} {'blue house' if k % 2 else 'house blue'} {messy.prose(k + 5000, 12)}") for k in range(1200)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    scored = toxicity.score_documents(frame, labels)
    _, predicted, label = held_out(scored, labels, "toxic")
    assert predicted[label == 1].mean() > 0.95 and predicted[label == 0].mean() < 0.05
    joined = {r["doc_id"]: r["score"] for r in toxicity.score_documents(frame, labels, max_local=0).collect()}
    assert joined == pytest.approx({r["doc_id"]: r["score"] for r in scored.collect()}, abs=1e-9)


def test_toxicity_tables_match_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = [(k, " ".join([f"{'vile' if k % 3 == 0 else 'kind'}{rng.integers(5)}", "trapeze" if k % 3 == 0 else "trapdoor", *(("red", "door") if k % 3 == 0 else ("door", "red"))] + [f"w{x}" for x in rng.integers(0, 30, 12)])) for k in range(400)]
    frame = spark.createDataFrame([(k, t, int(k % 3 == 0)) for k, t in docs], "id long, text string, toxic int")
    got = {(r["level"], r["key"] or (r["first"], r["second"])): r["gain"] for r in toxicity.expression_table(frame, 2.0).collect()}

    counts = {level: {} for level in (4, 5, 6, 0, -1)}
    for k, text in docs:
        found = text.split()
        for w in set(found):
            for p in (4, 5, 6, 0):
                counts[p].setdefault(w[:p] if p else w, [0, 0])[k % 3 == 0] += 1
        for pair in set(zip(found, found[1:])):
            counts[-1].setdefault(pair, [0, 0])[k % 3 == 0] += 1
    factor, want = {}, {}

    def gains(level, key, whole):
        own, parts = counts[level][key], []
        for c in (0, 1):
            expected = sum(own) * whole[c] / sum(whole)
            gap = own[c] - expected
            parts.append((expected + np.sign(gap) * max(abs(gap) - 2.0 * np.sqrt(expected + 1), 0) + 0.5) / (expected + 0.5))
        return parts

    totals = [sum(x[c] for x in counts[0].values()) for c in (0, 1)]
    for n, p in enumerate((4, 5, 6, 0)):
        for key in counts[p]:
            below = factor[(4, 5, 6)[n - 1], key[:(4, 5, 6)[n - 1]]] if n else (1.0, 1.0)
            parts = gains(p, key, [totals[c] * below[c] for c in (0, 1)])
            factor[p, key] = [below[c] * parts[c] for c in (0, 1)]
            if parts != [1.0, 1.0]:
                want[p, key] = np.log(parts[1] / parts[0])
    for first, second in counts[-1]:
        parts = gains(-1, (first, second), [counts[0][first][c] * factor[0, second][c] for c in (0, 1)])
        if parts != [1.0, 1.0]:
            want[-1, (toxicity.word_hash(first), toxicity.word_hash(second))] = np.log(parts[1] / parts[0])
    assert len(want) >= 8 and {level for level, _ in want} >= {4, 5, -1} and got == pytest.approx(want)
