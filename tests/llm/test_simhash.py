import collections
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from kinfold.llm import prefixes, simhash
from kinfold.llm.planes import Planes
from kinfold.operators.components import connected_components


def brute_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    root = dict(pairs)
    for i in root:
        root[i] = i
    changed = True
    while changed:
        changed = False
        for i, a in pairs.items():
            low = min(root[j] for j, b in pairs.items() if (a ^ b).bit_count() <= 4)
            if low < root[i]:
                root[i], changed = low, True
    return root


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "cé", " ", " ", "\n", "x\ty", "DDD"]), max_size=30).map(" ".join))
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text, 4)) == brute_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 9))
def test_planes_equal_popcount(seed, radius):
    rng = np.random.default_rng(seed)
    fps = np.unique(np.concatenate([rng.integers(0, 2**64, 30, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))]))
    planes = Planes(fps)
    for fp in fps[::17]:
        assert planes.within(int(fp), radius).tolist() == np.flatnonzero(np.bitwise_count(fps ^ fp) <= radius).tolist()


def test_links_reach_all_near_pairs(spark):
    rng = np.random.default_rng(5)
    fps = {0, 2**64 - 1}
    for base in rng.integers(0, 2**64, 12, dtype=np.uint64).tolist():
        for k in (0, 1, 2, 3, 4, 5, 7):
            fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    pairs = dict(enumerate(sorted(fps)))
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in pairs.items()]
    frame = spark.createDataFrame(rows, "rep long, fp long")
    want = brute_components(pairs)
    for cell in (2, 2048):
        found = {r.node: r.component for r in connected_components(simhash.links(frame, cell=cell)).collect()}
        assert {i: found.get(i, i) for i in pairs} == want


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text, "x"), (3, text.upper(), None), (9, text.replace("word7 ", "wordx "), None), (2, None, "x"), (1, "", "x"), (7, "  \n", "y"), (8, "two words", ""), (8, "two words", ""), (6, "Ünrelated text of some words", "")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want = {i: brute_fingerprint(t) for i, t, _ in rows}
    parts = brute_components(want)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((i, f"{want[i]:016x}", parts[i]) for i, _, _ in rows)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    parts = brute_components(want)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {i: (f"{f:016x}", parts[i]) for i, f in want.items()}


def test_similar_groups(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for family in range(12):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([60, 200, 500]))]
        for k in range(4):
            text = list(base)
            for at in rnd.sample(range(len(base)), int(len(base) * [0, 0, 0.004, 0.5][k])):
                text[at] = f"x{rnd.randrange(10**6)}"
            rows.append((family * 10 + k, " ".join(text), 0))
            want[family * 10 + k] = family * 10 + (3 if k == 3 else 0)
    rows += [(500, None, 1), (501, "", 1), (502, "two words", 1), (502, "two words", 1), (None, "x", 1)]
    want |= {500: 500, 501: 500, 502: 502}
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string, fp0 long")).collect()
    assert len(found) == len(rows) - 1
    assert {r.doc_id: r.component_id for r in found} == want
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_similar_groups_recall(spark):
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, pairs = [], []
    while len(pairs) < 400:
        base = word(int(rng.integers(60, 400)))
        near = list(base)
        for at in rng.choice(len(near), int(len(near) * rng.uniform(0.005, 0.025)) + 1, replace=False):
            near[at] = word(1)[0]
        if 0.8 <= simhash.jaccard(" ".join(base), " ".join(near), 5) <= 0.95:
            pairs.append((2 * len(pairs), simhash.jaccard(" ".join(base), " ".join(near), 5)))
            rows += [(pairs[-1][0], " ".join(base)), (pairs[-1][0] + 1, " ".join(near))]
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.951)):
        hit = [found[i + 1] == i for i, j in pairs if low <= j < high]
        print(f"recall at {low}-{high}: {sum(hit)} of {len(hit)}")
        assert len(hit) > 20 and sum(hit) >= 0.95 * len(hit)
    assert all(found[i] == i for i, _ in pairs)


def test_similar_groups_of_large_buckets(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
    texts = []
    for _ in range(300):
        near = list(base)
        for at in rng.choice(300, 4, replace=False):
            near[at] = f"x{rng.integers(0, 10**9)}"
        texts.append(near)
    texts.insert(150, base)  # alike with each copy, which are less alike among themselves
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    near = [simhash.jaccard(rows[150][1], t, 5) for _, t in rows]
    assert min(near) >= 0.8 > simhash.jaccard(rows[0][1], rows[1][1], 5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (100, 2048):
        groups = {r.component_id for r in simhash.similar_groups(frame, cell=cell).collect()}
        print("groups:", len(groups))
        assert groups == {0}


def brute_groups(rows, words=5):
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(t or "")
    root, ids = {i: i for i in sets}, sorted(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(simhash.jaccard(x, y, words) >= 0.8 for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed, cell", [(1, 16), (2, 2048)])
def test_similar_groups_equal_brute_force(spark, seed, cell):
    """Families whose members differ from their base by more or less than a fifth;
    the base comes late, and the first member is unlike most."""
    rnd = random.Random(seed)
    rows = []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(rnd.choice([60, 120, 240]))]
        for k in range(60):
            text = list(base)
            for at in rnd.sample(range(len(base)), int(len(base) * rnd.choice([0.0, 0.01, 0.015, 0.02, 0.03, 0.05]))):
                text[at] = f"x{rnd.randrange(10**7)}"
            rows.append((1000 * family + k, " ".join(text)))
        rows.append((1000 * family + 999, " ".join(base)))
    rows += [(3, rows[200][1]), (None, rows[0][1]), (7000, None), (7001, " ")]
    want = brute_groups(rows)
    assert 8 < len(set(want.values())) < len(want) - 100
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.similar_groups(frame, cell=cell).collect()
    lost = [r.doc_id for r in found if want[r.doc_id] != r.component_id]
    print("not as by brute force:", len(lost), "of", len(found))
    assert len(lost) <= 0.02 * len(found)  # bands miss a pair at 0.8 with a chance of 0.01


def test_prefixes_lose_no_pair(spark):
    rnd = random.Random(9)
    sets = []
    for k in range(150):
        base = set(range(100 * (k % 6), 100 * (k % 6) + 100))
        sets.append(sorted(base - set(rnd.sample(sorted(base), rnd.randrange(40))) | {rnd.randrange(10**6) for _ in range(rnd.randrange(20))}))
    rows = [(k, 7, len(x), x, 0, k) for k, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "rep long, sid long, size int, grams array<long>, fp0 long, comp long")
    posts = prefixes.postings(frame.drop("comp"), 0.8, ["fp0"]).withColumn("comp", F.col("rep"))
    alike = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and alike(a, b)}
    for cell in (10, 2048):
        found = {tuple(r) for r in prefixes.with_all(posts, 0.8, ["fp0"], 60, cell).collect()}
        assert want <= found and len(want) > 50
    assert {tuple(r) for r in prefixes.with_first(posts, 0.8, ["fp0"], 60, 2048).collect()} <= found


def test_boilerplate_does_not_join(spark):
    rnd = random.Random(3)
    line = " ".join(["the same nine words stand in each of them"] * 200)
    rows = [(i, line + " " + " ".join(f"w{rnd.randrange(10**7)}" for _ in range(120))) for i in range(3)]
    assert simhash.jaccard(rows[0][1], rows[1][1], 5) < 0.1
    assert {r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 1, 2}


def test_hot_buckets_are_cut_again(spark):
    rng = np.random.default_rng(8)
    shifts = lambda k: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (400, k), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([np.uint64(9) ^ shifts(k) for k in (2, 5, 8)]))
    pairs = dict(enumerate(fps.tolist()))
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in pairs.items()]
    found = {r.node: r.component for r in connected_components(simhash.links(spark.createDataFrame(rows, "rep long, fp long"), cell=64)).collect()}
    assert {i: found.get(i, i) for i in pairs} == brute_components(pairs)


def test_very_long_text(spark):
    text = " ".join(f"w{k % 70001}" for k in range(300_000))
    found = simhash.near_duplicates(spark.createDataFrame([(4, text), (2, text + " more")], "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {2}
    assert {r.component_id for r in simhash.similar_groups(spark.createDataFrame([(4, text), (2, text + " more")], "doc_id long, text string")).collect()} == {2}
