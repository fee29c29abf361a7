"""Merkle fixity audit of WARC archives.

Each archive is a run of WARC records at known offsets. A leaf covers a fixed range of offsets and hashes the
records that start in it, in offset order; a node above covers ``fanout`` times the range below and hashes its
children. Two replicas are compared from the roots down: a level is read only below the nodes that differed above,
so an intact archive costs one comparison.

Defined results: a record is bad where its digest, length or presence differs between the replicas. Null URL or
payload counts as empty. Rows with the same archive and offset (repeated rows) are hashed in digest order and
compared as a multiset. Empty replicas have no tree: auditing them gives no rows, and every record is bad where
only one is empty. Records of any length are hashed whole by the JVM. Only the named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastops.llm.common import plain_text, shared_rows

LEAF_BYTES = 1 << 18
FANOUT = 16
PAGES_PER_ARCHIVE = 1000


def warc_records(pages: DataFrame, pages_per_archive: int = PAGES_PER_ARCHIVE) -> DataFrame:
    """``archive``, ``record_id`` and ``record`` (the WARC text) of every page; consecutive ids share an archive."""
    payload = plain_text(F.col("html"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), plain_text(F.col("url")), F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))
    return pages.select(F.coalesce(F.floor(F.col("page_id") / pages_per_archive), F.lit(-1)).cast("long").alias("archive"),
                        F.col("page_id").alias("record_id"), record.alias("record"))


def manifest(records: DataFrame, **copies: Column) -> DataFrame:
    """Archive, id, offset, length and SHA-256 of every record as written, without the records themselves.

    ``copies`` names further replicas, each with an expression for what it holds in place of ``record`` (null where
    it has lost it); they add ``length_<name>`` and ``digest_<name>``. Records are laid end to end by id. An archive
    is bounded by its number of ids, so the running offset is summed within a bounded group.
    """
    size = lambda c: F.octet_length(c).cast("long")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    own = F.col("record")
    rows = records.select("archive", "record_id", size(own).alias("length"), digest(own).alias("digest"),
                          *[f(c).alias(f"{label}_{name}") for name, c in copies.items() for label, f in (("length", size), ("digest", digest))])
    before = Window.partitionBy("archive").orderBy(F.col("record_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def replica(rows: DataFrame, name: str | None = None) -> DataFrame:
    """The digests that one replica holds: archive, offset, length, record_id and digest."""
    tail = f"_{name}" if name else ""
    return rows.where(F.col(f"digest{tail}").isNotNull()).select(
        "archive", "offset", F.col(f"length{tail}").alias("length"), "record_id", F.col(f"digest{tail}").alias("digest"))


def merkle_tree(digests: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT, levels: int = 6) -> DataFrame:
    """Nodes ``(archive, level, node, hash)`` of every archive's tree, level 0 being the leaves.

    ``levels`` fixes the height: ``leaf_bytes * fanout ** levels`` is the largest archive with one root (beyond it
    an archive has several roots, which are all compared).
    """
    level = digests.groupBy("archive", F.floor(F.col("offset") / leaf_bytes).alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))).alias("parts"))
    text = F.concat_ws("\n", F.transform("parts", lambda r: F.concat_ws(" ", r["offset"].cast("string"), r["length"].cast("string"), r["digest"])))
    level = level.select("archive", "node", F.sha2(text, 256).alias("hash"))
    tree = shared_rows(level.withColumn("level", F.lit(0)))
    out, below = tree, tree
    for k in range(1, levels + 1):
        below = below.groupBy("archive", F.floor(F.col("node") / fanout).alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("parts")).select(
            "archive", "node", F.sha2(F.concat_ws("\n", F.transform("parts", lambda r: F.concat_ws(" ", r["node"].cast("string"), r["hash"]))), 256).alias("hash"),
            F.lit(k).alias("level"))
        out = out.unionByName(below)
    return out.select("archive", "level", F.col("node").cast("long").alias("node"), "hash")


def differing_leaves(tree_a: DataFrame, tree_b: DataFrame, fanout: int = FANOUT, levels: int = 6) -> DataFrame:
    """Archive and node of the leaves that differ, found by descending from the roots."""
    bad: DataFrame | None = None
    for k in range(levels, -1, -1):
        sides = []
        for name, tree in (("a", tree_a), ("b", tree_b)):
            side = tree.where(F.col("level") == k).select("archive", "node", F.col("hash").alias(name))
            if bad is not None:
                side = side.withColumn("parent", F.floor(F.col("node") / fanout)).join(
                    bad.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi").drop("parent")
            sides.append(side)
        bad = sides[0].join(sides[1], ["archive", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")
        bad = shared_rows(bad)
    return bad


def audit(digests_a: DataFrame, digests_b: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT, levels: int = 6) -> DataFrame:
    """Records that differ: archive, offset, record_id, and length and digest in either replica (null where missing)."""
    trees = [shared_rows(merkle_tree(d, leaf_bytes, fanout, levels)) for d in (digests_a, digests_b)]
    leaves = differing_leaves(*trees, fanout, levels)
    sides = []
    for name, digests in (("a", digests_a), ("b", digests_b)):
        near = digests.withColumn("node", F.floor(F.col("offset") / leaf_bytes)).join(leaves, ["archive", "node"], "left_semi")
        same = Window.partitionBy("archive", "offset", "record_id").orderBy("digest")
        sides.append(near.select(
            "archive", "offset", F.row_number().over(same).alias("copy"), F.coalesce(F.col("record_id").cast("string"), F.lit("")).alias("key"),
            F.struct("record_id", "length", "digest").alias(name)))
    held = lambda f: [F.col(f"{n}.{f}").alias(f"{f}_{n}") for n in ("a", "b")]
    return sides[0].join(sides[1], ["archive", "offset", "key", "copy"], "full").where(
        ~(F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.length").eqNullSafe(F.col("b.length")))).select(
        "archive", "offset", F.coalesce("a.record_id", "b.record_id").alias("record_id"), *held("length"), *held("digest"))
