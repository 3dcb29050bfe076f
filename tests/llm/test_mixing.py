import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    found = mixing.source_targets(sizes)
    assert sum(found) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s + 1e-9 for t, s in zip(found, sizes))
    unit = {t / w for t, s, w in zip(found, sizes, [5, 2, 1] * 3) if t < 2 * s - 1e-9}
    assert not unit or max(unit) == pytest.approx(min(unit))
    assert all(t / w <= min(unit) * (1 + 1e-9) for t, s, w in zip(found, sizes, [5, 2, 1] * 3) if unit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=6), st.integers(1, 9))
def test_tree_uses_quotas_up(quotas, shards):
    leaves = mixing.splitting_tree(quotas, shards, 3)
    assert [sum(leaf[i] for leaf in leaves) for i in range(len(quotas))] == quotas
    assert all(q >= 0 for leaf in leaves for q in leaf)
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 1


def rows_of(n=60):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["b", "a", "é", "big", "big", "big", None]), 5) for i in range(n)]
    return rows + [(100, None, "a", None), (101, "", "none", 0), (102, "x y", "b", 1), (102, "x y", "b", 1), (None, "a b c", None, 1)]


def test_takes_targets(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    found = mixing.mixed_sizes(frame, block=8).collect()
    assert len(found) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sums = [sum(size(t) for _, t, s, _ in rows if s == n) for n in names]
    target = dict(zip(names, mixing.source_targets(sums)))
    source = {r[0]: r[2] for r in rows}
    for n, s in zip(names, sums):
        own = [r for r in found if source[r.doc_id] == n]
        assert {(r.source_size, r.target) for r in own} == {(s, target[n])}
        assert abs(sum(r.taken for r in own) - target[n]) <= 1
    assert all(r.taken <= 2 * r["size"] for r in found)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixed_sizes(frame.repartition(7), block=8).collect()))


def test_draws_are_disjoint_and_fill_shards(spark):
    rows = mixing.sized_rows(spark.createDataFrame([r[:3] for r in rows_of()], "doc_id long, text string, source string"))
    _, draws = mixing.mix(rows, shards=5, block=8)
    found = draws.collect()
    assert len({(r.row, r.part, r.epoch) for r in found}) == len(found)
    per = [sum(r.shard == k for r in found) for k in range(5)]
    assert sum(per) == len(found) and max(per) - min(per) <= 1


def test_the_tree_decides(spark, monkeypatch):
    """The mix is what the leaves draw; a tree that gives less takes less."""
    rows = mixing.sized_rows(spark.createDataFrame([r[:3] for r in rows_of()], "doc_id long, text string, source string"))
    made, tree = [], mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: made.append(tree(*a)) or made[-1])
    plan, draws = mixing.mix(rows, shards=5, block=8)
    names = [r.source for r in plan.collect()]
    source = {r.row: r.source for r in rows.collect()}
    found = [[0] * len(names) for _ in range(5)]
    for r in draws.collect():
        found[r.shard][names.index(source[r.row])] += 1
    assert found == made[0] and sum(map(sum, found)) > 100
    sizes = lambda: {(r.doc_id, r.taken, r.first_shard) for r in mixing.mixed_sizes(spark.createDataFrame([r[:3] for r in rows_of()], "doc_id long, text string, source string"), shards=5, block=8).collect()}
    whole = sizes()
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: [tree(*a)[0]])
    assert sum(t for _, t, _ in sizes()) < sum(t for _, t, _ in whole) / 2


def test_draws_equal_a_plain_version(spark):
    """The first blocks of each source's order, as often as its target asks."""
    frame = spark.createDataFrame([r[:3] for r in rows_of()], "doc_id long, text string, source string")
    rows = mixing.sized_rows(frame)
    _, draws = mixing.mix(rows, shards=3, block=8)
    found = {}
    for r in draws.collect():
        found.setdefault(r.row, {}).setdefault(r.part, []).append(r.words)
    for own in rows.collect():
        n = -(-own["size"] // 8)
        parts = [(k + 1) * own["size"] // n - k * own["size"] // n for k in range(n)]
        for part, times in found.get(own.row, {}).items():
            assert all(0 < w <= parts[part] for w in times) and len(times) <= 2
            assert len(times) < 2 or max(times) == parts[part]


def test_repeated_rows_are_told_apart(spark):
    rows = mixing.sized_rows(spark.createDataFrame([(None, "same words here", "a")] * 300 + [(1, "x", "a")], "doc_id long, text string, source string"))
    found = {r.row: r["copy"] for r in mixing._numbered(rows).collect()}
    same = [found[r.row] for r in rows.where("doc_id is null").collect()]
    assert sorted(same) == list(range(300)) and len(found) == 301


def test_documents(spark):
    rows = [(i, t, s, len(t or "")) for i, t, s, _ in rows_of()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = mixing.mixed_documents(frame, block=8).collect()
    taken = {}
    for r in mixing.mixed_sizes(frame, block=8).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = {}
    for r in found:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in taken.items() if v}


def test_empty(spark):
    assert mixing.mixed_sizes(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    assert mixing.mixed_documents(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
