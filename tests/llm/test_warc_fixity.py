from pyspark.sql import functions as F

from forecastops.llm import warc_fixity as w


def pages(spark, n=400):
    rows = [(k, f"http://h/{k}", "p" * (k * 37 % 900), "x") for k in range(n)] + [(None, None, None, "x"), (3, "http://h/3", "p" * 111, "x"), (3, "http://h/3", "p" * 111, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_audit_finds_exactly_the_differences(spark):
    n, own = F.col("record_id"), F.col("record")
    held = F.when(n == 7, F.concat(own, F.lit("x"))).when(n.isin(150, 151), F.lit(None)).when(n == 399, F.upper(own)).when(n.isNull(), F.lit("q")).otherwise(own)
    rows = w.manifest(w.warc_records(pages(spark), 100), b=held).cache()
    a, b = w.replica(rows), w.replica(rows, "b")
    for leaf, fanout, levels in ((512, 2, 4), (1 << 18, 16, 2)):
        found = w.audit(a, b, leaf, fanout, levels).collect()
        assert sorted(str(r["record_id"]) for r in found) == ["150", "151", "399", "7", "None"]
        assert {r["record_id"] for r in found if r["length_b"] is None} == {150, 151}
    assert w.audit(a, a, 512, 2, 4).count() == 0
    assert w.audit(b, a, 512, 2, 4).count() == 5
    assert w.audit(a, b.limit(0), 512, 2, 4).count() == a.count()
    assert w.audit(a.limit(0), a.limit(0), 512, 2, 4).count() == 0


def test_offsets_lie_end_to_end_and_intact_branches_are_not_read(spark):
    rows = w.manifest(w.warc_records(pages(spark), 100)).collect()
    for archive in {r["archive"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["archive"] == archive)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    frame = spark.createDataFrame(rows)
    changed = frame.withColumn("digest", F.when((F.col("archive") == 2) & (F.col("record_id") == 205), F.lit("0")).otherwise(F.col("digest")))
    trees = [w.merkle_tree(w.replica(f), 512, 4, 3) for f in (frame, changed)]
    leaves = w.differing_leaves(*trees, fanout=4, levels=3).collect()
    assert len(leaves) == 1 and leaves[0]["archive"] == 2
