"""Alignment of two tokenizers: which tokens of one stand for which of the other, and how often in the whole corpus.

A text with a blank in front is encoded by a byte-level tokenizer (A) and a piece tokenizer (B). Byte offsets at which
tokens of both end cut them into groups; every A-B pair of token occurrences within a group is a link. The count of an id pair
is the number of documents that hold it linked.

Counting uses a minimal perfect hash of the distinct pairs. The first pass aligns every text and writes its chunk's
distinct pairs with their documents. Distinct pairs are dealt to shards by a hash; each shard gets a perfect hash function
(levels of bit arrays; what collides goes to the next level, and a key's index is the rank of its bit) with its keys in
index order. Chunks are gathered sixteen at a time into a dense vector of counts for each shard, indexed by that function,
and the vectors are added up in a tree, sixteen a step. Then the pairs each chunk holds are looked up in the vectors (the key
found at the index is compared, so a foreign pair cannot take another's count), and the second pass aligns the chunk's
texts again beside its counts. Chunks and shards have bounded sizes; their numbers grow with the data. Only the
highest count of each A id goes to all tasks: at most one number for each id of the vocabulary.

Both tokenizers never join what a blank after other text separates: A splits words off first, and no piece of B has a
blank behind another character (checked when the vocabulary is read). So the stretches between such blanks are encoded and
aligned on their own as arrays, each different one once as long as a task remembers it (``KNOWN_PARTS``).

Defined results: null and empty texts, and texts whose joined A or B bytes are not those of the text with a blank in
front, have no tokens, no links and empty groups. Texts are used whole; a text must fit in a row. Repeated rows count
as often as they occur. An empty table gives an empty table. Only ``doc_id`` and ``text`` are read, besides the
caller's columns being hashed to deal rows to chunks, so names do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecastops.llm.common import shared_rows

CHUNK_BYTES = 8 << 20
SHARD_KEYS = 32_000
FAN = 16
BATCH_CHARS = 1 << 20
KNOWN_PARTS = 400_000
JOINED = 64
# The pattern by which byte-level vocabularies of this kind split words off.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LARGE_GROUP = 4096
BITS_PER_KEY = 2
SIDE = 1 << 17  # more than the ids of either vocabulary: a pair, or a text and a pair, is one number
# A blank after anything that no definition of white space covers; the last character stays with what is before it.
CUT = re.compile(r"(?<=\S) (?!\Z)")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, made from the bytes of their files, and the bytes of every id.

    The byte-level vocabulary's file lists its joins in the order of their ids, so an encoder that knows the ids alone
    gives the same tokens; strings of special tokens are plain text to it.
    """

    def __init__(self, byte_level: bytes, pieces: bytes):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        spec, alphabet = json.loads(byte_level), byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        joins = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][m.replace(" ", "")] for m in joins]
        if order != sorted(order) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("the byte-level vocabulary does not list its joins by id, or changes texts first")
        self.a = Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=pieces)
        by_id = {i: t for t, i in ranks.items()}
        self.a_bytes = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(r"[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            raise ValueError("pieces go on after a blank: texts cannot be cut there")
        if max(len(self.a_bytes), len(self.b_bytes)) >= SIDE:
            raise ValueError("vocabulary too large")

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def spell(self, ids: list[int]) -> bytes:
        """Bytes of B ids."""
        return b"".join(map(self.b_bytes.__getitem__, ids))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, list[list[int]], list[int]]:
        """A ids of all parts in a row, B ids of all parts that B does not change, and the places of those it does.

        Each part stands behind a blank; joined by it they are encoded as if alone.
        """
        a = self.a.encode_to_numpy(f" {' '.join(parts)}").astype(np.int64)
        joined = [" ".join(parts[at:at + JOINED]) for at in range(0, len(parts), JOINED)]
        b: list[list[int]] = []
        changed: list[int] = []
        for k, (text, ids) in enumerate(zip(joined, self.b.encode(joined, num_threads=1))):
            if self.spell(ids) == f" {text}".encode():
                b.append(ids)
                continue
            for at in range(k * JOINED, min(len(parts), (k + 1) * JOINED)):
                ids = self.b.encode(parts[at])
                if self.spell(ids) == f" {parts[at]}".encode():
                    b.append(ids)
                else:
                    changed.append(at)
        return a, b, changed


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


@dataclass
class Aligned:
    """Texts aligned together: counts of A ids, B ids, groups and links of each text, its spelled groups, and of every
    distinct (text, pair), in that order, the number of links."""

    sizes: np.ndarray
    spelled: list[str]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    """Aligns lists of texts: each different part once, all new ones together as arrays.

    What is known of parts is kept up to ``KNOWN_PARTS`` of them, then forgotten. Without ``spell`` the groups of texts
    are not written out.
    """

    def __init__(self, byte_level: bytes, pieces: bytes, spell: bool = True):
        self.spell = spell
        self._forget()
        self.tokenizers = Tokenizers(byte_level, pieces)
        tables = [self.tokenizers.a_bytes, self.tokenizers.b_bytes]
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in tables]
        # Ids as text with what follows them: within a group a comma, at its end a bar (A) or a semicolon (B).
        self.inner, self.last = ([np.array([f"{i}{mark}" for i in range(len(table))], object) for table, mark in zip(tables, marks)] for marks in (",,", "|;"))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.good, self.table, self.spelled = np.zeros(0, bool), np.zeros((0, 4), np.int64), []
        self.pairs, self.times, self.entries = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, parts: Iterable[str]) -> None:
        """Align the parts not known yet."""
        different = dict.fromkeys(parts)
        new = [p for p in different if p not in self.known]
        if self.known and len(self.known) + len(new) > KNOWN_PARTS:
            self._forget()
            new = list(different)
        if not new:
            return
        good, table, spelled, pairs, times, entries = self._parts(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.spelled += spelled
        self.good, self.table = np.concatenate([self.good, good]), np.concatenate([self.table, table])
        self.pairs, self.times, self.entries = (np.concatenate(x) for x in ((self.pairs, pairs), (self.times, times), (self.entries, entries)))

    def _parts(self, parts: list[str]):
        """Of every part: whether B spells its bytes, its four counts, spelled groups; and its links as one ragged array."""
        # Parts that end in a blank would run into the blank after them: they are encoded alone.
        lengths = np.array([len(p.encode()) + 1 for p in parts], np.int64)
        alone = np.array([p[-1:].isspace() for p in parts], bool)
        place, cut = np.argsort(alone, kind="stable"), int((~alone).sum())
        ordered, good = [parts[k] for k in place.tolist()], np.ones(len(parts), bool)
        ids: list = [[np.zeros(0, np.int64)], []]
        for begin, some in [(0, ordered[:cut])] * (cut > 0) + [(k, [ordered[k]]) for k in range(cut, len(ordered))]:
            a, b, changed = self.tokenizers.encode(some)
            ids[0].append(a)
            ids[1] += b
            good[place[[begin + k for k in changed]]] = False
        ids = [np.concatenate(ids[0]), np.fromiter(chain.from_iterable(ids[1]), np.int64)]
        # Which part a token lies in follows from where its bytes end; parts that B changes have no tokens at all.
        offsets = np.cumsum(lengths[place])
        of_a = place[np.searchsorted(offsets, np.cumsum(self.lengths[0][ids[0]]))]
        ids[0], of_a = ids[0][good[of_a]], of_a[good[of_a]]
        offsets = np.cumsum(lengths[place[good[place]]])
        of_b = place[good[place]][np.searchsorted(offsets, np.cumsum(self.lengths[1][ids[1]]))]
        # Back from joined to listed order, in which parts are numbered.
        ids, counts = [x[np.argsort(of, kind="stable")] for x, of in zip(ids, (of_a, of_b))], [np.bincount(of, minlength=len(parts)) for of in (of_a, of_b)]
        ends = [np.cumsum(self.lengths[k][ids[k]]) for k in (0, 1)]
        common = np.intersect1d(ends[0], ends[1], assume_unique=True)
        group = [np.searchsorted(common, ends[k]) for k in (0, 1)]
        sizes = [np.bincount(group[k], minlength=len(common)) for k in (0, 1)]
        begins = [np.cumsum(sizes[k]) - sizes[k] for k in (0, 1)]
        part = np.repeat(np.arange(len(parts)), counts[0])
        part_of_group = part[begins[0]] if len(common) else np.zeros(0, np.int64)

        spelled = [""] * len(parts)
        if self.spell:
            order = np.empty(len(ids[0]) + len(ids[1]), object)
            for k in (0, 1):
                place = np.arange(len(ids[k]))
                ending = place == (begins[k] + sizes[k] - 1)[group[k]]
                before = (begins[1] if k == 0 else begins[0] + sizes[0])[group[k]]
                order[place + before] = np.where(ending, self.last[k][ids[k]], self.inner[k][ids[k]])
            ordered, cuts = order.tolist(), np.cumsum(np.concatenate([[0], counts[0] + counts[1]])).tolist()
            spelled = ["".join(ordered[x:y]) for x, y in zip(cuts, cuts[1:])]

        plain = sizes[0] * sizes[1] <= LARGE_GROUP
        token = np.flatnonzero(plain[group[0]])
        repeat = sizes[1][group[0][token]]
        other = _ragged(begins[1][group[0][token]], repeat)
        pairs, of, times = [np.repeat(ids[0][token], repeat) * SIDE + ids[1][other]], [np.repeat(part[token], repeat)], [np.ones(len(other), np.int64)]
        for g in np.flatnonzero(~plain).tolist():  # different ids with their counts: equal ones are not paired one by one
            (x, n), (y, m) = (np.unique(ids[k][begins[k][g]:begins[k][g] + sizes[k][g]], return_counts=True) for k in (0, 1))
            pairs.append((x[:, None] * SIDE + y[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
            of.append(np.full(len(pairs[-1]), part_of_group[g]))
        pairs, of, times = (np.concatenate(x) for x in (pairs, of, times))
        if not plain.all():
            order = np.argsort(of, kind="stable")
            pairs, of, times = pairs[order], of[order], times[order]
        linked = np.bincount(of, times, len(parts)).astype(np.int64)
        table = np.stack([counts[0], counts[1], np.bincount(part_of_group, minlength=len(parts)), linked], axis=1)
        return good, table, spelled, pairs, times, np.bincount(of, minlength=len(parts))

    def align(self, texts: list[str | None]) -> Aligned:
        cut = [CUT.split(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self._learn(flat)
        index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), [len(parts) for parts in cut])
        whole = np.bincount(owner, ~self.good[index], len(texts)) == 0
        index, owner = index[whole[owner]], owner[whole[owner]]
        sizes = np.stack([np.bincount(owner, self.table[index, k], len(texts)) for k in range(4)], axis=1).astype(np.int64)
        entries = self.entries[index]
        place = _ragged((np.cumsum(self.entries) - self.entries)[index], entries)
        key, at = np.unique(np.repeat(owner, entries) * SIDE * SIDE + self.pairs[place], return_inverse=True)
        cuts, listed = np.cumsum(np.concatenate([[0], np.bincount(owner, minlength=len(texts))])).tolist(), index.tolist()
        strings = ["".join([self.spelled[i] for i in listed[x:y]])[:-1] for x, y in zip(cuts, cuts[1:])]
        return Aligned(sizes, strings, key // (SIDE * SIDE), key % (SIDE * SIDE), np.bincount(at, self.times[place], len(key)).astype(np.int64))


def batches(texts: list[str | None], size: int = BATCH_CHARS) -> Iterator[list[str | None]]:
    """Lists of texts of about ``size`` characters together."""
    out, n = [], 0
    for text in texts:
        out.append(text)
        n += len(text or "") + 100
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


class PerfectHash:
    """Minimal perfect hash of different 64-bit keys: an index from 0 to their number for each of them, alone."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            return ((x ^ x >> np.uint64(31)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, parts, left = [], [], keys
        while len(left):
            size = BITS_PER_KEY * len(left)
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of a key not built in, any index or -1."""
        out, begin, left = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = begin + self._place(keys[left], level, size)
            hit = self.bits[place]
            out[left[hit]] = self.rank[place[hit]]
            left, begin = left[~hit], begin + size
        return out

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, sizes, data: bytes) -> "PerfectHash":
        return cls(list(sizes), np.unpackbits(np.frombuffer(data, np.uint8), count=int(sum(sizes))).astype(bool))


def _files(byte_level: str, pieces: str) -> tuple[bytes, bytes]:
    """Both vocabularies as bytes, which travel with the tasks: executors need no copy of the files."""
    return Path(byte_level).read_bytes(), Path(pieces).read_bytes()


def chunk_pairs(chunked: DataFrame, files: tuple[bytes, bytes]) -> DataFrame:
    """First pass: ``chunk``, ``pair`` and the number of the chunk's documents that link it."""
    made: list[Aligner] = []  # one for each task, which may have several chunks

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Aligner(*files, spell=False))
        found = [np.zeros(0, np.int64)] + [made[0].align(texts).pair for texts in batches(frame["text"].tolist())]
        pairs, counts = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"chunk": np.full(len(pairs), frame["chunk"].iloc[0] if len(frame) else 0), "pair": pairs, "n": counts})

    return chunked.groupBy("chunk").applyInPandas(run, "chunk long, pair long, n long")


def perfect_hashes(pairs: DataFrame) -> DataFrame:
    """For each shard its distinct pairs' perfect hash (``sizes``, ``bits``) and the pairs in index order (``keys``)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame["pair"].to_numpy(np.int64)
        built = PerfectHash.build(keys)
        ordered = np.empty(len(keys), np.int64)
        ordered[built.index(keys)] = keys
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "sizes": [built.sizes], "bits": [built.to_bytes()], "keys": [ordered.tobytes()]})

    return pairs.select("shard", "pair").distinct().groupBy("shard").applyInPandas(run, "shard long, sizes array<long>, bits binary, keys binary")


def _indexed(frame: pd.DataFrame, table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Index of every pair of ``frame`` in its shard's table of one row, and the shard's keys; each is verified."""
    row = table.iloc[0]
    keys = np.frombuffer(row["keys"], np.int64)
    place = PerfectHash.from_bytes(row["sizes"], row["bits"]).index(frame["pair"].to_numpy(np.int64))
    if (place < 0).any() or (keys[place] != frame["pair"].to_numpy(np.int64)).any():
        raise ValueError("a pair is not in its shard's perfect hash")
    return place, keys


def _for_nodes(tables: DataFrame, pairs: DataFrame) -> DataFrame:
    """A copy of each shard's table for every node (group of chunks) that has pairs of the shard."""
    nodes = pairs.select("shard", "node").distinct().select(F.col("shard").alias("shard"), F.col("node").alias("node"))
    return nodes.join(tables, "shard")


def count_vectors(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """The shards' tables with ``counts``: a dense vector in index order, summed over nodes in a tree."""
    def leaf(frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        place, keys = _indexed(frame, table)
        total = np.bincount(place, frame["n"].to_numpy(np.float64), len(keys)).astype(np.int64)
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "node": [frame["node"].iloc[0]], "counts": [total.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in frame["counts"]], axis=0, dtype=np.int64)
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "node": [frame["node"].iloc[0] // FAN], "counts": [total.tobytes()]})

    schema = "shard long, node long, counts binary"
    vectors = pairs.groupBy("shard", "node").cogroup(_for_nodes(tables, pairs).groupBy("shard", "node")).applyInPandas(leaf, schema)
    nodes = (pairs.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        vectors = vectors.groupBy("shard", F.floor(F.col("node") / FAN)).applyInPandas(add, schema)
        nodes = -(-nodes // FAN)
    return tables.join(vectors.select("shard", "counts"), "shard")


def highest_counts(tables: DataFrame) -> np.ndarray:
    """For every A id the highest count of its pairs: one number for each id of the vocabulary."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for keys, counts in zip(frame["keys"], frame["counts"]):
                a, place = np.unique(np.frombuffer(keys, np.int64) // SIDE, return_inverse=True)
                best = np.zeros(len(a), np.int64)
                np.maximum.at(best, place, np.frombuffer(counts, np.int64))
                yield pd.DataFrame({"a": a, "best": best})

    rows = tables.select("keys", "counts").mapInPandas(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).collect()
    out = np.zeros(max([r["a"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        out[r["a"]] = r["best"]
    return out


def chunk_counts(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """``chunk``, ``pair`` and its count over all documents, for every pair of each chunk."""
    def run(frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        place, _ = _indexed(frame, table)
        return pd.DataFrame({"chunk": frame["chunk"], "pair": frame["pair"], "count": np.frombuffer(table["counts"].iloc[0], np.int64)[place]})

    return pairs.groupBy("shard", "node").cogroup(_for_nodes(tables, pairs).groupBy("shard", "node")).applyInPandas(run, "chunk long, pair long, count long")


def pair_tables(docs: DataFrame, files: tuple[bytes, bytes], chunk_bytes: int = CHUNK_BYTES, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their ``chunk``; the chunks' pairs by shard and node; and the shards' tables with their counts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    # Equal texts under different ids go to different chunks.
    chunked = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    pairs = shared_rows(chunk_pairs(chunked.where(F.length("text") > 0), files))
    shards = max(1, -(-pairs.select("pair").distinct().count() // shard_keys))
    pairs = pairs.withColumn("shard", F.pmod(F.xxhash64("pair"), F.lit(shards))).withColumn("node", F.floor(F.col("chunk") / FAN))
    tables = shared_rows(perfect_hashes(pairs))
    return chunked, pairs, shared_rows(count_vectors(pairs, tables))


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align_documents(docs: DataFrame, byte_level: str, pieces: str, chunk_bytes: int = CHUNK_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Of every row ``doc_id``, how many tokens, groups and links it has, ``n_best``, ``count_sum`` and its spelled ``groups``.

    ``n_best`` counts the links whose count is the highest of their A id; ``count_sum`` adds the counts of all links.
    """
    files = _files(byte_level, pieces)
    chunked, pairs, tables = pair_tables(docs, files, chunk_bytes, shard_keys)
    best = highest_counts(tables)

    made: list[Aligner] = []

    def run(key: tuple, frame: pa.Table, counted: pa.Table) -> pa.Table:
        if not made:
            made.append(Aligner(*files))
        order = np.argsort(counted["pair"].to_numpy())
        known, counts = counted["pair"].to_numpy()[order], counted["count"].to_numpy()[order]
        tables, spelled = [np.zeros((0, 6), np.int64)], []
        for texts in batches(frame["text"].to_pylist()):
            found = made[0].align(texts)
            count = counts[np.searchsorted(known, found.pair)] if len(known) else found.pair
            total = lambda values: np.bincount(found.text, values, len(texts)).astype(np.int64)  # noqa: B023, E731
            top = np.where(count == best[found.pair // SIDE], found.times, 0)
            tables.append(np.column_stack([found.sizes, total(top), total(found.times * count)]))
            spelled += found.spelled
        columns = np.concatenate(tables)
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        return pa.table({"doc_id": frame["doc_id"]} | {n: pa.array(columns[:, k]) for k, n in enumerate(names)} | {"groups": pa.array(spelled, pa.string())})

    kind = chunked.schema["doc_id"].dataType.simpleString()
    return chunked.groupBy("chunk").cogroup(chunk_counts(pairs, tables).groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, {RESULT}")


def alignment_report(rows: DataFrame) -> DataFrame:
    """``align_documents`` with the digest of the groups in their place: empty where there are none."""
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return rows.withColumn("groups_sha256", digest).drop("groups")
