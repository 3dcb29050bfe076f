import collections
import hashlib
import random

import numpy as np
import pytest

from kinfold.llm import lines

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if i is None or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=120):
    rnd = random.Random(seed)
    pool = ["the common line of all documents", "  The COMMON line of all documents\t", "short", "", "é" * 20, "é" * 19, "exactly twenty chars", *(f"line number {k} which is long enough" for k in range(60))]
    return [(i, "\n".join(rnd.choices(pool, k=rnd.randint(1, 9)))) for i in range(n)] + [(200, None), (201, ""), (202, pool[0]), (202, pool[0]), (None, pool[0])]


@pytest.mark.parametrize("keys", [65536, 8])
def test_equals_brute_force(spark, monkeypatch, keys):
    monkeypatch.setattr(lines, "SHARD_KEYS", keys)
    rows = rows_of(keys)
    found = lines.digest(lines.dedup_lines(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h1 long")))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_the_filter_decides(spark):
    """Lines that a filter denies are not counted; one that admits all loses nothing."""

    class Denies(lines.CuckooFilter):
        def contains(self, h1, h2):
            return np.zeros(len(h1), dtype=bool)

    class Admits(lines.CuckooFilter):
        def contains(self, h1, h2):
            return np.ones(len(h1), dtype=bool)

    rows = [(i, f"a line of three documents, number {i % 20}") for i in range(60)]
    refs = lines.written(lines.references(spark.createDataFrame(rows, "doc_id long, text string")), "refs")
    assert lines.dropped_keys(refs).count() == 40
    assert lines.dropped_keys(refs, make=Admits).count() == 40
    assert lines.dropped_keys(refs, make=Denies).count() < 40


def test_very_long_text(spark):
    rows = [(i, "\n".join(f"line number {k} of a long text" for k in range(60_000 + i))) for i in range(3)]
    found = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: (60_000, 60_000), 1: (60_001, 60_000), 2: (60_002, 0)}


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = lines.digest(lines.dedup_lines(docs))
    assert sorted(map(tuple, found.collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_cuckoo_filter_holds_and_deletes():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-(2**63), 2**63, (2, 5000))
    f = lines.CuckooFilter(5000)
    f.insert(h1, h2)
    assert not f.full and f.contains(h1, h2).all()
    f = lines.CuckooFilter(state=f.state())
    f.delete(h1[:2500], h2[:2500])
    assert f.contains(h1[2500:], h2[2500:]).all() and f.contains(h1[:2500], h2[:2500]).mean() < 0.01


def test_full_filter_admits_all():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(-(2**63), 2**63, (2, 5000))
    f = lines.CuckooFilter(64)
    f.insert(h1, h2)
    assert f.full and lines.CuckooFilter(state=f.state()).contains(h1, h2).all()
    f.delete(h1, h2)


def test_index_inserts_and_deletes(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)  # so that the filters must be laid out anew
    rows = rows_of(3, 40)
    refs = lambda part: lines.written(lines.references(spark.createDataFrame(part, "doc_id long, text string")), "refs")
    both = lambda x: sorted(map(tuple, x.collect()))
    index = lines.LineIndex.empty(spark).insert(refs(rows[:25])).insert(refs(rows[20:]))
    whole, part = both(lines.dropped_keys(refs(rows))), both(lines.dropped_keys(refs(rows[:25])))
    assert both(index.drops()) == whole and whole != part
    less = index.delete(refs(rows[25:]))
    assert both(less.drops()) == part
    assert both(less.insert(refs(rows[25:])).drops()) == whole
