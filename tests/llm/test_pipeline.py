"""Each stage of the pipeline on its own input, against brute force."""

import messy
import pytest
from test_line_dedup import brute
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from forecastops.llm import decontaminate
from forecastops.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    tables = [read(spark, SF_DIR, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF_DIR).cache())
    return tables


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_stay_until_the_last_stage(steps):
    for table in steps[:-1]:
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good_labelled_documents(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF_DIR, "labels").collect()}
    kept = {i for i, _ in pairs(steps[1])}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)
    assert set(pairs(steps[1])) <= set(pairs(steps[0]))


def test_lines_near_duplicates_and_benchmark(spark, steps):
    assert pairs(steps[2]) == sorted((i, t) for i, _, _, t in brute(pairs(steps[1])))
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())
    rows = pairs(steps[2])
    groups = plain_components([plain_fingerprint(t) for _, t in rows])
    first = {}
    for (i, _), g in zip(rows, groups):
        first[g] = min(i, first.get(g, i))
    assert pairs(steps[3]) == [r for r in rows if r[0] in set(first.values())]
    items = [(r["item_id"], r["text"]) for r in read(spark, SF_DIR, "benchmark").collect()]
    block = decontaminate.ItemBlock(items, 4, 3)
    clean = [(i, t) for i, t in pairs(steps[3]) if not any(
        decontaminate.align(own, block.encode(t))[0] >= decontaminate.MIN_SCORE * len(own) for own in block.ids)]
    assert pairs(steps[4]) == clean and 0 < len(clean) < len(pairs(steps[3]))


def test_mixture_is_made_of_what_was_kept(steps):
    kept = {i for i, _ in pairs(steps[4])}
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} <= kept and all(0 < r["taken"] <= 2 * r["size"] for r in rows)


def test_run_is_the_stages_in_a_row(spark, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(str, steps[5].collect()))


def test_messy_and_empty_documents(spark):
    for docs in (messy.documents(spark), messy.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            out.count()
            if stage is not corpus_pipeline.mix:
                assert out.columns == docs.columns


def test_rows_without_an_id_stay_in_near_dedup(spark):
    docs = messy.documents(spark)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()
    assert sum(r["doc_id"] is None for r in out) == sum(r[0] is None for r in messy.rows())
    assert {r["doc_id"] for r in out} >= {0, 10, 12} and not {1, 4, 5} & {r["doc_id"] for r in out}


def test_repeated_ids_lose_no_group(spark):
    a, b = messy.prose(1, 60), messy.prose(2, 60)
    docs = spark.createDataFrame([(9, a), (9, b), (20, b), (9, a)], "doc_id long, text string")
    assert pairs(corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)) == sorted([(9, a), (9, b)])


def test_names_used_inside_the_stages_may_be_columns(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "row", "key", "fp", "first", "root", "__row", "__lines", "lines", "left", "__drop", "kept", "h", "pos"]
    docs = spark.createDataFrame([(k, messy.prose(k // 2, 60) + "\nA line that all share", "en", "s", *[1] * (len(names) - 4)) for k in range(8)], names)
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_duplicates):
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == names
    assert [i for i, _ in pairs(docs)] == [0, 1, 2, 4, 6]  # 0 kept the shared line: it is no copy of 1 any more


def test_line_dedup_replaces_columns_of_its_own_names(spark):
    from forecastops.llm import line_dedup
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "x", 5, 6)], ["doc_id", "text", "__n_lines", "row"])).collect()[0]
    assert got.asDict() == {"doc_id": 1, "text": "x", "row": 6, "__n_lines": 1, "__n_dropped": 0}
