import zlib

import numpy as np
import pytest

from kinfold.llm import quality


def rows_of(n=60):
    good, bad = "the plain words of a text, as usual", "b!! %%% x### y$$$ ### !!"
    return [(i, f"{good if i % 3 else bad} {i}", 7.0) for i in range(n)], [(i, int(i % 3 > 0), 0) for i in range(n)]


def test_learns_and_keeps_folds_apart(spark):
    docs, labels = rows_of()
    docs += [(100, None, 1.0), (101, "", 1.0), (102, "word " * 3000, 1.0), (3, docs[3][1], 2.0), (None, "no id", 0.0)]
    labels += [(4, None, 1), (None, 1, 1), (5, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.scored(d, quality.fit(d, lab)).collect()
    assert len(found) == len(docs) and found[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    truth = dict((i, y) for i, y, _ in labels[:60])
    assert np.mean([r.predicted == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]) == 1
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in labels[:60]], lab.schema)
    clean = spark.createDataFrame(labels[:60], lab.schema)
    assert np.array_equal(quality.fit(d, clean)[0], quality.fit(d, flipped)[0])


def test_word_sums_equal_document_average():
    weight = np.random.default_rng(0).normal(size=quality.BUCKETS)
    text = "Some some some words, words äöü again again %%% x1"
    at, counts = quality.document_features(text, {})
    odds = weight[at] @ (counts / counts.sum()) + 0.25
    assert quality.Scorer(weight, 0.25).score(text) == pytest.approx(1 / (1 + np.exp(-odds)))


def test_shape_shortcut():
    for w in ["a", "ab", "Ab", "Abc", "ABc", "éa", "Éab", "a1", "A--b", "x%%%", "", "ǅab"]:
        kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w)
        if w != "ǅab":
            assert quality.shape(w) == quality._RUNS.sub(r"\1+", kinds)


def test_no_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r)[2:] for r in quality.scored(d, quality.fit(d, none)).collect()] == [(0.5, 1)]
    assert quality.scored(d.limit(0), quality.fit(d.limit(0), none)).collect() == []


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 50 and np.mean([r.predicted == r.quality for r in found]) > 0.95


def test_labels_that_disagree_teach_nothing(spark):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "bad %% junk ") * 5, "x") for i in range(40)], "doc_id long, text string, y string")
    labels = [(i, i % 2) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    less = quality.fit(docs, frame([x for x in labels if x[0] >= 6]))
    both = quality.fit(docs, frame(labels + [(i, 1 - i % 2) for i in range(6)] + labels[6:9]))
    assert np.array_equal(less[0], both[0]) and less[1] == both[1]


def test_features_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "bad %% junk ") * 5) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    taught = []
    monkeypatch.setattr(quality, "train", lambda documents: taught.append(sum(len(b) for b, *_ in documents)))
    quality.fit(docs, labels)
    monkeypatch.setattr(quality, "FEATURES", 200)
    quality.fit(docs, labels)
    assert taught[0] > 200 >= taught[1] > 100


def test_ties_nulls_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (2, "same text"), (None, None), (3, ""), (4, "word " * 200_000)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(3, 1), (4, 0), (None, 1)], "doc_id long, quality int"))
    found = quality.scored(docs, model).collect()
    score = {r.doc_id: r.score for r in found}
    assert len(found) == 6 and score[1] == score[2] and score[None] == score[3] and all(0 <= r.score <= 1 for r in found)


def test_features_go_to_the_driver_in_few_bytes(spark, monkeypatch):
    for most in (1, 255, 256, 65535, 65536, 10**6):
        counts = np.array([1, most, 3])
        packed = quality.narrow(counts)
        assert quality.widths(bytes(6), packed).tolist() == counts.tolist()
    assert len(quality.narrow(np.array([1, 255]))) == 2 and len(quality.widths(b"", b"")) == 0
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "bad %% junk ") * (5 if i else 70_000)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    taught = []
    monkeypatch.setattr(quality, "train", lambda documents: taught.extend(documents))
    quality.fit(docs, labels)
    kinds = [(b.dtype.itemsize, c.dtype.itemsize) for b, c, _ in taught]
    assert len(taught) > 20 and set(kinds) == {(2, 1), (2, 4)}
    expected = {len(c): c.sum() for c in (quality.document_features("good words " * 5, {})[1], quality.document_features("bad %% junk " * 5, {})[1])}
    assert all(int(c.sum()) == expected[len(c)] for _, c, _ in taught if c.dtype.itemsize == 1)
