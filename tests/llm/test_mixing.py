import math
from collections import defaultdict

import messy
import pytest
from pyspark.sql import functions as F

from forecastops.llm import mixing


def result(docs, **options):
    placed, targets, mixture = mixing.mix_sources(docs, **options)
    return mixing.taken_words(placed, targets, mixture).collect(), targets.collect(), mixture


@pytest.mark.parametrize("block", [1, 7, 512])
def test_taken_words_fill_each_target(spark, block):
    docs = messy.documents(spark)
    rows, targets, mixture = result(docs, block_words=block)
    assert len(rows) == docs.count()
    taken, size = defaultdict(int), defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for t in targets:
        assert taken[t["source"]] == math.floor(t["target"]) and size[t["source"]] == t["source_size"]
        assert t["target"] <= 2 * t["source_size"]
    assert mixture.agg(F.sum("words")).first()[0] == sum(taken.values())
    assert sorted(map(str, rows)) == sorted(map(str, result(docs, block_words=block)[0]))  # reruns agree


def test_targets_share_the_excess_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    caps, weights, budget = {"a": 200, "b": 2000, "c": 2, None: 1000}, {"a": 5, "b": 2, "c": 1, None: 5}, 1601 * 1.5
    full = {}
    while True:  # brute force: fill what is above its cap, share the rest again
        open_sources = [s for s in caps if s not in full]
        left = budget - sum(full.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_sources) for s in open_sources}
        above = [s for s in open_sources if share[s] > caps[s]]
        if not above:
            break
        full |= {s: caps[s] for s in above}
    assert got == pytest.approx(full | share)


def test_every_stretch_of_the_schedule_is_near_the_weights(spark):
    sizes = spark.createDataFrame([("a", 50_000), ("b", 70_000), ("c", 60_000)], "source string, source_size long")
    targets = mixing.source_targets(sizes)
    slots = [r["source"] for r in mixing.schedule(targets, 100, chunk=256).orderBy("slot").collect()]
    goal = {s: slots.count(s) / len(slots) for s in "abc"}
    for at in range(0, len(slots) - 200, 97):
        for s in "abc":
            assert abs(slots[at:at + 200].count(s) - 200 * goal[s]) <= 6


def test_empty_table(spark):
    rows, targets, mixture = result(messy.empty(spark))
    assert rows == [] and targets == [] and mixture.count() == 0
