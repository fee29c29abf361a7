import hashlib

import messy
import pytest

from forecastops.llm import line_dedup as d

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    last = float("inf")
    owners = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                owners.setdefault(key(line), set()).add(last if r[0] is None else r[0])
    out = []
    for r in rows:
        lines, own = (r[1] or "").split("\n"), last if r[0] is None else r[0]
        kept = [x for x in lines if not (len(key(x)) >= 10 and min(owners[key(x)]) != own)]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (4, 2), (9, 2)])
def test_same_as_brute_force(spark, batches, fanout):
    got = d.dedup_lines(messy.documents(spark), batches=batches, fanout=fanout)
    assert set(messy.documents(spark).columns) < set(got.columns)
    assert sorted([(r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"]) for r in got.collect()], key=str) == brute(messy.rows())


def test_empty_table(spark):
    assert d.dedup_lines(messy.empty(spark)).count() == 0


def test_runs_hold_each_key_once_and_are_compacted(spark):
    runs = d.LineRuns(spark, fanout=2)
    h = lambda k: hashlib.md5(str(k).encode()).digest()
    for b in range(5):
        runs.add(spark.createDataFrame([(h(k), b) for k in range(b * 10, b * 10 + 15)], d.RUN_SCHEMA))
    held = {bytes(r["h"]): r["owner"] for r in runs.read().collect()}
    assert runs.read().count() == len(held) == 55
    assert held[h(12)] == 0 and held[h(50)] == 4
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    for path in [p for level in runs.levels for p in level]:
        for part in spark.read.parquet(path).rdd.glom().collect():
            assert [bytes(r["h"]) for r in part] == sorted(bytes(r["h"]) for r in part)


@pytest.mark.parametrize("ids", [[0, 2 ** 62 - 3, 2 ** 62 - 2, 2 ** 62 - 1], [-2 ** 63, -2 ** 62, 0, 2 ** 63 - 2, 2 ** 63 - 1]])
@pytest.mark.parametrize("batches", [4, 6])
def test_ids_over_the_whole_range(spark, ids, batches):
    rows = [(i, f"A line that all documents share\nown line of number {i}") for i in ids]
    got = d.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches)
    assert sorted([(r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"]) for r in got.collect()], key=str) == brute(rows)


def test_late_batches_read_a_compacted_run(spark, monkeypatch):
    seen, read = [], d.LineRuns.read
    monkeypatch.setattr(d.LineRuns, "read", lambda self: (seen.append([len(level) for level in self.levels]), read(self))[1])
    rows = [(i, f"A line that all documents share\nown line of number {i}") for i in range(12)]
    got = d.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([(r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"]) for r in got.collect()], key=str) == brute(rows)
    assert any(len(levels) > 1 and levels[1] for levels in seen)
