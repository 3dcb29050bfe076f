import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import graph

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, asks, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((i, tuple(v)), np.array(v))
    out = {}
    for (i, _), q in ok.items():
        if asks(i):
            near = sorted(((-float(q @ x), j) for (j, _), x in ok.items() if j != i and len(x) == len(q)))[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return out


def answer(frame, **options):
    out = {}
    for r in sorted(graph.nearest(frame, F.col("vec_id") % 20 == 0, **options).collect()):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(found, want):
    hit = sum(len({j for _, j, _ in found.get(q, [])} & {j for _, j, _ in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


def test_small_shards_with_bad_rows_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.2, 1, 5])).tolist()) for i in range(200)]
    for i in (20, 21, 40, 41, 42, 60, 199):
        rows[i] = (i, rows[20][1])
    bad = [(1000, None), (1020, [0.0] * 6), (1040, [None] * 6), (1060, [float("inf")] * 6), (1080, [1.0, 2.0]), (1081, [2.0, 1.0]), (1100, []), (None, [1.0] * 6), (3, rows[3][1])]
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad], SCHEMA)
    want = brute(rows + bad, lambda i: i % 20 == 0, 5)
    found = answer(frame, k=5, shard=20)
    assert set(found) == set(want)
    for q, w in want.items():
        assert [x[:2] for x in found[q]] == [x[:2] for x in w]
        assert np.allclose([x[2] for x in found[q]], [x[2] for x in w], rtol=1e-12)


def test_recall_on_a_whole_graph(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], lambda i: i % 20 == 0, 20)
    assert recall(answer(table), want) >= 0.95


def test_every_node_is_reached():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(300, 5)) * 0.01 + 10 * c for c in np.eye(5)])
    g = graph.Graph(points)
    seen, todo = {g.start}, [g.start]
    while todo:
        for j in g.links[todo.pop()].tolist():
            if j >= 0 and j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == len(points)


def test_empty(spark):
    assert answer(spark.createDataFrame([], SCHEMA)) == {}
