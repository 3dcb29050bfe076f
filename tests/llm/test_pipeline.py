import collections
import hashlib

import corpus_pipeline
from kinfold.llm import mixing, simhash
from kinfold.operators.storage import written
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_groups

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return df.orderBy("doc_id").collect()


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]

    good = written(stages["quality classifier"](spark, docs, SF), "t1")
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == bool(y) for i, y in labels.items()]
    assert good.columns == docs.columns and sum(right) / len(right) > 0.9

    lined = written(stages["line dedup"](spark, good, SF), "t2")
    want = [(i, h) for i, _, _, h in brute_lines([(r.doc_id, r.text) for r in good.collect()])]
    assert lined.columns == docs.columns
    assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in lined.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = written(stages["SimHash near-dedup"](spark, lined, SF), "t3")
    before, after = rows_of(lined), rows_of(single)
    left = {r.doc_id for r in after}
    assert single.columns == docs.columns and left < {r.doc_id for r in before}
    texts = {r.doc_id: r.text for r in before}
    near = collections.defaultdict(set)
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            j = simhash.jaccard(texts[a], texts[b], 5)
            if j >= 0.8:
                near[a].add(b)
                near[b].add(a)
            if j == 1:
                assert not (a in left and b in left)
    for i in set(ids) - left:  # whatever went is linked to something that stays
        seen, todo = {i}, [i]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        assert seen & left

    mixed = written(stages["mixing sources to target weights"](spark, single, SF), "t4")
    size, taken = collections.Counter(), collections.Counter()
    for r in after:
        size[r.source] += len(r.text.split())
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    names = sorted(size)
    for n, t in zip(names, mixing.source_targets([size[n] for n in names])):
        assert abs(taken[n] - t) <= 1
    assert mixed.columns == docs.columns


def test_run_packs_everything(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert found


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, shard int, fp0 long, score double"


def odd_rows():
    """Nulls, empty, repeated and very long texts, and columns named as in operators."""
    prose = " ".join(f"word{k % 977} is here" for k in range(400))
    line = "this line stands in many of the documents"
    rows = [(i, f"{line}\n{prose} {i}\nown line of document number {i}", "en", f"s{i % 3}", None) for i in range(8)]
    rows += [(20, None, None, None, None), (21, "", "en", "s0", 0), (22, None, "en", "s1", 0), (None, prose + " end", "en", "s1", 9), (None, None, None, None, None)]
    rows += [(30, "a text that is repeated in full", "en", "s2", 31)] * 3 + [(31, " ".join(f"w{k}" for k in range(120_000)), "en", "s0", 1)]
    return [(*r, 1, 2, 3, 0.5) for r in rows]


def test_stages_with_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: collections.Counter(r.doc_id for r in df.collect())
    want = collections.Counter(r[0] for r in odd_rows())

    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns and not ids(good) - want

    lined = written(stages["line dedup"](spark, docs, SF), "odd")
    assert lined.columns == docs.columns and ids(lined) == want
    kept = {r.doc_id: r.text for r in lined.collect()}
    assert [i for i in range(8) if "this line stands" in kept[i]] == [7] and kept[20] == kept[22] == ""
    assert {(r.h1, r.shard, r.fp0, r.score) for r in lined.collect()} == {(1, 2, 3, 0.5)}

    single = written(stages["SimHash near-dedup"](spark, docs, SF), "odd")
    assert single.columns == docs.columns
    assert ids(single) == {0: 1, 20: 1, None: 2, 30: 3, 31: 1}

    mixed = written(stages["mixing sources to target weights"](spark, docs, SF), "odd")
    assert mixed.columns == docs.columns and not set(ids(mixed)) - set(want)
    assert all(r.n_chars == len(r.text) for r in mixed.collect() if r.text is not None)

    packed = stages["packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(want)
    assert sum(r.length for r in packed if r.doc_id == 30) == 3 * next(r.doc_tokens for r in packed if r.doc_id == 30)


def test_stages_with_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        assert found.collect() == [] and (name == "packing" or found.columns == docs.columns)


def test_near_copies_go_and_others_stay(spark):
    """Each document with a similar one but the smallest of its group goes, no other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert left == {i for i, low in want.items() if i == low}
