import numpy as np
import pytest

from kinfold.llm import quantise

SCHEMA = "vec_id long, embedding array<double>, label int, n long"


def brute(rows):
    ok = lambda v, lab, i: i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    scaled = [np.array(v) / np.abs(v).max() if ok(v, lab, i) else None for i, v, lab in rows]
    unit = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    near = [[b for b in range(len(rows)) if b != a and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98] for a in range(len(rows))]
    root = list(range(len(rows)))
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        part = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(near[a]), part, rows[a][0] is not None and rows[a][0] == part))
    assert root
    return sorted(out, key=str)


def rows_of(seed, n=300, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, d))
    noise = rng.choice([0.0, 0.02, 0.1, 0.2, 0.3], size=(n, 1)) * rng.normal(size=(n, d))
    vecs = base[rng.integers(len(base), size=n)] + noise * np.abs(base).mean()
    rows = [(i, v.tolist(), int(rng.integers(2))) for i, v in enumerate(vecs)]
    rows[9] = (9, rows[3][1], rows[3][2])
    rows[10] = (10, (3 * np.array(rows[3][1])).tolist(), rows[3][2])
    return rows + [(1000, None, 1), (1001, [0.0] * d, 1), (1002, [None] + [1.0] * (d - 1), 1), (1003, [float("nan")] * d, 1), (1004, [float("inf")] + [0.0] * (d - 1), 1), (1005, rows[3][1], None), (1006, rows[4][1][:5], rows[4][2]), (1006, rows[4][1][:5], rows[4][2]), (1007, [], 0), (1008, [1e200] * d, 0), (1009, [1e200] * d, 0)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(quantise, "RESIDENTS", 5)
        monkeypatch.setattr(quantise, "QUERIES", 11)
        monkeypatch.setattr(quantise, "BLOCK", 3)
    rows = rows_of(1 + small)
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    found = quantise.near_vectors(frame, lists=9, subspaces=4, codes=16, sample=120)
    want = [w for w in brute(rows)]
    assert sorted(map(tuple, found.collect()), key=str) == want


def test_empty(spark):
    assert quantise.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_small_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted(map(tuple, quantise.near_vectors(table).collect()), key=str) == brute(rows)
