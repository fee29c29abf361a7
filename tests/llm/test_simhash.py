import random

import messy
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from forecastops.llm import simhash as s


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(values):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints_and_components_of_messy_documents(spark):
    rows = messy.rows()
    got = s.near_duplicates(messy.documents(spark)).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_components(fps)
    smallest = {g: min((r[0] for r, o in zip(rows, groups) if o == g and r[0] is not None), default=None) for g in groups}
    expected = [(r[0], signed(f), smallest[g]) for r, f, g in zip(rows, fps, groups)]
    assert sorted([tuple(r) for r in got], key=str) == sorted(expected, key=str)
    assert s.near_duplicates(messy.empty(spark)).count() == 0


def test_fingerprint_hash_is_the_one_sql_has(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ä b c"))).first()[0] == signed(xxhash.xxh64_intdigest("ä b c".encode(), seed=42))
    assert s.fingerprint_of(" Ä b C ") == plain_fingerprint("Ä b C")


def test_linked_fingerprints_share_an_anchor():
    rng, parts = np.random.default_rng(3), s._parts()
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    near = []
    for values in (x, y):
        anchors, places = s.anchors_of(values, parts)
        sets = [set() for _ in values]
        for a, p in zip(anchors.tolist(), places.tolist()):
            sets[p].add(a)
        near.append(sets)
    assert all(a & b for a, b in zip(*near))
    assert sum(map(len, near[0])) / len(x) < 18


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_links_connect_like_brute_force(spark, limit):
    rng = random.Random(limit)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        v = rng.choice(values)
        for _ in range(rng.choice([1, 2, 2, 3])):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted(set(values))
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = s.links(frame, limit)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    roots = {r["node"]: r["root"] for r in s.components(edges).collect()}
    assert same_partition([roots.get(signed(v), signed(v)) for v in values], plain_components(values))


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(k, k + 1) for k in range(500)]
    star = [(1000, 1001 + k) for k in range(500)]
    got = {r["node"]: r["root"] for r in s.components(spark.createDataFrame(chain + star + [(1, 0), (7, 7)], "a long, b long")).collect()}
    assert len(got) == 501 + 501
    assert len({got[k] for k in range(501)}) == 1 == len({got[k] for k in range(1000, 1501)}) and got[0] != got[1000]
    assert s.components(spark.createDataFrame([], "a long, b long")).count() == 0
