import itertools
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.operators import linkage, naming, pairs
from kinfold.operators.components import connected_components
from kinfold.options import GroupingError, GroupingOptions, alpha_of
from kinfold.plans import catalog


def plain_complete_link(n, edges):
    close = np.eye(n, dtype=bool)
    for a, b in edges:
        close[a, b] = close[b, a] = True
    groups = [{i} for i in range(n)]
    own = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        a, b = sorted((own[i], own[j]))
        if a != b and all(close[x, y] for x in groups[a] for y in groups[b]):
            groups[a] |= groups[b]
            for x in groups[b]:
                own[x] = a
            groups[b] = set()
    return {frozenset(g) for g in groups if len(g) > 1}


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 10), st.data())
def test_complete_link(n, data):
    edges = data.draw(st.lists(st.sampled_from(list(itertools.combinations(range(n), 2))), unique=True, min_size=1))
    owner = linkage.greedy_complete_link([(f"{a:02d}", f"{b:02d}") for a, b in edges])
    groups = {}
    for k, v in owner.items():
        groups.setdefault(v, set()).add(int(k))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == plain_complete_link(n, edges)
    assert all(int(k) == min(g) for k, g in groups.items())


def test_order_matters():
    group = lambda e: {k: v for k, v in linkage.greedy_complete_link(e).items()}
    assert group([("a", "b"), ("b", "c")]) == {"a": "a", "b": "a", "c": "c"}
    assert group([("a", "c"), ("b", "c")]) == {"a": "a", "b": "b", "c": "a"}


def plain_average_link(v, cut):
    far = 1 - v @ v.T
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        d, a, b = min((far[np.ix_(x, y)].mean(), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2))
        if d >= cut:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 14), st.integers(0, 10**6), st.floats(0.05, 1.5))
def test_average_link(n, seed, cut):
    v = np.random.default_rng(seed).normal(size=(n, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = linkage.average_link(v, cut)
    assert {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())} == plain_average_link(v, cut)


def test_banded_join_misses_nothing(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(25)] + [0, 2**64 - 1]
    rows = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(5)]
    frame = spark.createDataFrame([(f"{i:03d}", h - 2**64 if h >> 63 else h) for i, h in enumerate(rows)], "k string, h long")
    found = sorted((r.src, r.dst, r.distance) for r in pairs.hamming_pairs(frame, "k", "h").collect())
    assert found == sorted((f"{a:03d}", f"{b:03d}", (x ^ y).bit_count()) for (a, x), (b, y) in itertools.combinations(enumerate(rows), 2) if (x ^ y).bit_count() <= 4)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    edges = [*chain, *star, (5, 5), (2000, 2001), (2001, 2000)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}, 2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_blocks_give_all_pairs(spark):
    v = np.random.default_rng(3).normal(size=(40, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(f"{i:02d}", x.tolist()) for i, x in enumerate(v)], "key string, v array<double>")
    found = sorted((r.src, r.dst) for r in pairs.cosine_edges(frame, 0.5, block=7).collect())
    assert found == sorted((f"{a:02d}", f"{b:02d}") for a, b in itertools.combinations(range(40), 2) if 1 - v[a] @ v[b] < 0.5)


def test_bounds_and_zero_means(spark):
    assert naming.name_of(9999, 1) == "9999-00000001.png"
    for bad in ((10000, 1), (1, 0), (True, 1)):
        with pytest.raises(GroupingError):
            naming.name_of(*bad)
    rows = spark.createDataFrame([("a", "g", [1.0, 0.0]), ("b", "g", [-1.0, 0.0])], "rel_path string, dup_group string, v array<double>")
    with pytest.raises(GroupingError):
        linkage.representatives(rows)
    assert alpha_of(20.0) == 0.8
    for bad in ({"threshold": -1}, {"threshold": float("nan")}):
        with pytest.raises(GroupingError):
            GroupingOptions(**bad)
    with pytest.raises(ValueError):
        GroupingOptions(alpha=1.5)


def labels_of(v, cut):
    far = np.clip(1 - v @ v.T, 0, 2)
    a, b = np.nonzero(np.triu(far < cut, 1))
    return linkage.linked_average(v, a, b, far[a, b], cut)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 14), st.integers(0, 10**6), st.floats(0.05, 1.5))
def test_average_link_from_close_pairs(n, seed, cut):
    v = np.random.default_rng(seed).normal(size=(n, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = labels_of(v, cut)
    assert {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())} == plain_average_link(v, cut)
    assert label.tolist() == linkage.average_link(v, cut).tolist() and all(label[x] == x for x in label)


def test_equal_distances_go_by_first_members():
    v = np.eye(4)[[0, 1, 2, 3, 0]]
    assert labels_of(v, 0.5).tolist() == [0, 1, 2, 3, 0]
    assert labels_of(v, 1.5).tolist() == [0, 0, 0, 0, 0]
    corner = np.array([[0.6, 0.8, 0.0], [0.6, 0.0, 0.8], [1.0, 0.0, 0.0]])  # the last is equally near to both
    assert labels_of(corner, 0.45).tolist() == [0, 1, 0]


def test_average_link_holds_no_square_matrix():
    v = np.random.default_rng(5).normal(size=(3000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    linkage.average_link(v, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000**2  # an eighth of such a matrix


def clusters_of(spark, v, cut):
    frame = spark.createDataFrame([(f"{i:03d}", x) for i, x in enumerate(v)], "dup_group string, v array<double>")
    found = {r.dup_group: r.cluster_key for r in linkage.average_link_clusters(frame, cut).collect()}
    assert len(found) == len(v)
    return [int(found[f"{i:03d}"]) for i in range(len(v))]


def test_ways_of_average_link_agree(spark, monkeypatch):
    v = np.random.default_rng(9).normal(size=(300, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = [*v.tolist(), None, [0.0] * 5]
    plain = [*linkage.average_link(np.array(v[:300]), 0.2).tolist(), 300, 301]
    assert clusters_of(spark, v, 0.2) == plain and 20 < len(set(plain)) < 200
    monkeypatch.setattr(linkage, "CLOSE", 0)
    assert clusters_of(spark, v, 0.2) == plain


def test_a_cut_beyond_all_distances_stores_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(linkage, "cosine_edges", None)
    assert clusters_of(spark, [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]], 2.5) == [0, 0, 0]


def test_strips_of_a_block_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "STRIP", 3)
    v = np.random.default_rng(3).normal(size=(40, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"{i:02d}", x.tolist()) for i, x in enumerate(v)] + [("none", None), ("zero", [0.0] * 3)]
    found = sorted((r.src, r.dst) for r in pairs.cosine_edges(spark.createDataFrame(rows, "key string, v array<double>"), 0.5, block=30).collect())
    assert found == sorted((f"{a:02d}", f"{b:02d}") for a, b in itertools.combinations(range(40), 2) if 1 - v[a] @ v[b] < 0.5)


def test_plans_without_files_hold_any_number_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(naming, "MAX_CLUSTERS", 1)
    rows = spark.createDataFrame([("a", "a", [1.0, 0.0]), ("b", "b", [0.0, 1.0])], "rel_path string, cluster_key string, v array<double>")
    with pytest.raises(GroupingError):
        naming.named_plan(rows)
    assert sorted(r.cluster for r in naming.named_plan(rows, bounded=False).collect()) == [1, 2]
    found = catalog.QUERIES["q_plan_clusters"](spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def test_flagship_clusters_once(spark, monkeypatch):
    """Numbers, references and distances all read the clusters, which are stored."""
    monkeypatch.setattr(naming, "MAX_CLUSTERS", 1)
    found = catalog.QUERIES["q_plan_grouping"](spark, "/root/testdata/sf0.001")
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len({r.output_name for r in rows}) == len({r.rel_path for r in rows}) == len(rows)
    assert all(r.output_name == f"{r.cluster:04d}-{r["index"]:08d}.png" for r in rows)
