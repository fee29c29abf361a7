"""Alignment of whole texts by another way, corpus counts by hand, and the perfect hash."""

import functools
import hashlib
from collections import Counter

import messy
import numpy as np
import pytest
from tokenizers import Tokenizer

from forecastops.llm import token_pairs as t
from forecastops.llm.common import read

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def tokenizers():
    return t.Tokenizers(*t._files(BYTE_LEVEL, PIECES))


@functools.cache
def reference():
    """The byte-level tokenizer as its own library reads the file."""
    made = Tokenizer.from_file(BYTE_LEVEL)
    made.encode_special_tokens = True
    return made


def whole(text, tk):
    """Groups of a text encoded in one piece, through sets of offsets."""
    if not text:
        return []
    a, b, own = reference().encode(" " + text, add_special_tokens=False).ids, tk.b.encode(text), (" " + text).encode()
    if b"".join(tk.a_bytes[i] for i in a) != own or b"".join(tk.b_bytes[i] for i in b) != own:
        return []
    ends_a, ends_b = np.cumsum([len(tk.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(tk.b_bytes[i]) for i in b]).tolist()
    both = sorted(set(ends_a) & set(ends_b))
    place = lambda ends: np.searchsorted(both, ends).tolist()
    groups = [([], []) for _ in both]
    for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
        for i, g in zip(ids, place(ends)):
            groups[g][side].append(i)
    return groups


def expected(rows, tk):
    groups = [whole(text, tk) for _, text in rows]
    counts = Counter(p for own in groups for p in {(x, y) for a, b in own for x in a for y in b})
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), own in zip(rows, groups):
        linked = [(x, y) for a, b in own for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((i, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(linked), sum(counts[p] == best[p[0]] for p in linked),
                    sum(counts[p] for p in linked), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "a  b   c \n\n d\t e ", " leading", "trailing  ", " nbsp  x　 y\x85 z\x1c w", "漢字 かな😀 👩‍👩‍👧 é é",
       "▁ a▁b ▁▁c", "don't we'll I'M 12345 3.14 ...!!!", "\x00 \x01\x7f", "ﬁ Ａ ① ㍿", "ααα" * 50, "0" * 500, "\r\n\r\n x", "ab" * 400 + " " * 70 + "q"]


def test_documents_match_whole_texts(spark, tokenizers):
    rows = [r[:2] for r in messy.rows()] + [(100 + k, x) for k, x in enumerate(ODD)]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "'x' AS pair", "2 AS shard").repartition(7)
    for chunk_bytes, shard_keys in ((1 << 14, 500), (1 << 24, 10**6)):  # a tree of several levels, then one chunk and one shard
        got = t.alignment_report(t.align_documents(docs, BYTE_LEVEL, PIECES, chunk_bytes, shard_keys))
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, tokenizers)


def test_every_document_is_cut_where_both_tokenizers_cut(spark, tokenizers):
    texts = [r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect() if r["text"]] + ODD
    aligner = t.Aligner(*t._files(BYTE_LEVEL, PIECES))
    for part in t.batches(texts):
        for text, spelled in zip(part, aligner.align(part).spelled):
            assert spelled == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in whole(text, tokenizers))


def test_forgetting_known_parts_changes_nothing(monkeypatch):
    aligner, texts = t.Aligner(*t._files(BYTE_LEVEL, PIECES)), [messy.prose(k, 50) for k in range(9)]
    plain = [aligner.align([x]).spelled for x in texts]
    monkeypatch.setattr(t, "KNOWN_PARTS", 60)
    again = t.Aligner(*t._files(BYTE_LEVEL, PIECES))
    assert plain == [again.align([x]).spelled for x in texts] and len(again.known) <= 60


def test_large_groups_are_paired_by_different_ids(monkeypatch):
    aligner, texts = t.Aligner(*t._files(BYTE_LEVEL, PIECES)), ["ααα" * 30 + " one two 123456", "xyzzy " * 9 + "漢字", "", "q"]
    plain = aligner.align(texts)
    monkeypatch.setattr(t, "LARGE_GROUP", 0)
    other = t.Aligner(*t._files(BYTE_LEVEL, PIECES)).align(texts)
    assert all(np.array_equal(x, y) for x, y in zip(vars(plain).values(), vars(other).values()))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(2**34, n, replace=False).astype(np.int64)
    built = t.PerfectHash.build(keys)
    again = t.PerfectHash.from_bytes(built.sizes, built.to_bytes())
    assert sorted(again.index(keys).tolist()) == list(range(n))
    other = again.index(np.arange(2**34, 2**34 + 100))
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_empty_table(spark):
    assert t.align_documents(messy.empty(spark), BYTE_LEVEL, PIECES).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in t.alignment_report(t.align_documents(nothing, BYTE_LEVEL, PIECES)).collect()] == [(0,) * 6 + ("",)] * 2
