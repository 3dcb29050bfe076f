import collections
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import passages

#: Share of edited passages of similarity 0.8 or more that must be found.
EDITED = 0.99


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    short, lines = prose(40), prose(13)
    planted = {k: prose(n) for k, n in enumerate((51, 52, 60, 75, 120, 400))}
    rows, holds = [], {}
    for i in range(60):
        text = prose(rnd.randint(0, 300))
        if i % 7 == 0:
            text += short + prose(30)
        text = lines + text
        if i % 2 == 0:
            k = rnd.randrange(len(planted))
            at = rnd.randint(0, len(text))
            text = text[:at] + planted[k] + text[at:]
            holds.setdefault(k, set()).add(i)
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(text).replace("abc", "ABC")))
    return rows, holds, planted


def test_planted_passages_are_caught_and_clean_left_alone(spark):
    for seed in (1, 2):
        rows, holds, planted = corpus(seed)
        rows += [(90, None), (91, ""), (None, rows[0][1]), (92, "one two")]
        frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, src string")
        found = passages.repeated_passages(frame).collect()
        want = {i for docs in holds.values() if len(docs) > 1 for i in docs}
        assert {r.doc_id for r in found} == want
        words = {i: (t or "").lower().split() for i, t in rows if i is not None}
        for k, docs in holds.items():
            if len(docs) > 1:
                own = [r for r in found if r.doc_id in docs]
                assert {r.component_doc for r in own} == {min(docs)}
                assert [r.doc_id for r in own if r.kept] == [min(docs)]
                for r in own:
                    text = " ".join(words[r.doc_id][r.start_word : r.end_word])
                    assert " ".join(planted[k]) in text and r.n_words <= len(planted[k]) + 3


def test_near_copies_and_exact_copies(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    near = list(base)
    near[150] = "changed"
    far = [w if k % 4 else "x" + w for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(far))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept) for r in found} == {(1, True), (2, False), (3, False)}
    assert max(r.n_words for r in found) == 300


def test_same_span_in_one_document_only(spark):
    text = " ".join(f"w{k}" for k in range(60))
    assert passages.repeated_passages(spark.createDataFrame([(1, text + " and " + text)], "doc_id long, text string")).collect() == []
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def edited_corpus(lengths, kinds, each, least):
    """Pairs of documents with a passage and its edited copy, and which pair has which."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**9)}"
    rows, asked = [], {}
    for n in lengths:
        for kind in kinds:
            done = 0
            while done < each:
                one = [word() for _ in range(n)]
                two = list(one)
                for k in range(max(1, n // 50)):
                    at = n // 2 if k == 0 else rnd.randrange(n)
                    two[at : at + (kind != "insert")] = [] if kind == "delete" else [word()]
                x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (one, two))
                if len(two) <= 50 or len(x & y) < least * len(x | y):
                    continue
                doc = 2 * len(asked)
                asked[doc] = (n, kind)
                rows += [(doc + side, " ".join([word() for _ in range(60)] + text + [word() for _ in range(60)])) for side, text in enumerate((one, two))]
                done += 1
    return rows, asked


def test_edited_passages(spark):
    rows, asked = edited_corpus((52, 60, 80, 100, 150), ("substitute", "insert", "delete"), 20, 0.8)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {i for i in {r.doc_id for r in found} if i in asked}
    for kind in ("substitute", "insert", "delete"):
        print(kind, [(n, sum(i in hit for i, x in asked.items() if x == (n, kind)), 20) for n in (52, 60, 80, 100, 150)])
    assert all(r.component_doc == r.doc_id - r.doc_id % 2 for r in found)
    assert len(hit) >= EDITED * len(asked)


def test_spans_over_edits():
    base = [f"w{k}" for k in range(80)]
    spans = lambda one, two, a, c: passages.verified_spans(passages.word_hashes(" ".join(one)), passages.word_hashes(" ".join(two)), [(a, c)])
    for edit, size in ((["x"], 0), (["x"], 1), ([], 1)):
        two = ["a", "b"] + base[:40] + edit + base[40 + size :] + ["c"]
        assert spans(["d"] + base, two, 1 + 5, 2 + 5) == [(1, 81, 2, len(two) - 1)]
    assert spans(base, base[:30] + ["x"] * 30 + base[60:], 0, 0) == []


def test_passages_around_a_frequent_line(spark):
    rnd = random.Random(9)
    prose = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    rows, shared = [], []
    for k in range(30):
        line = prose(35)
        text = prose(12) + line + prose(13)
        rows += [(10 * k, " ".join(prose(60) + line + prose(60)))]
        rows += [(10 * k + d, " ".join(prose(60) + text + prose(60))) for d in (1, 2)]
        shared += [10 * k + 1, 10 * k + 2]
    for k in range(30, 60):  # the first document has the line alone as well
        line = prose(45)
        text = prose(5) + line + prose(5)
        rows += [(10 * k, " ".join(prose(60) + line + prose(60) + text + prose(60))), (10 * k + 1, " ".join(prose(60) + text + prose(60)))]
        shared += [10 * k, 10 * k + 1]
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("shared", [sum(i in found for i in shared if (i < 300) == one) for one in (True, False)], [60, 60])
    assert sorted(found) == sorted(shared)


def test_every_place_in_the_first_document(spark):
    rnd = random.Random(10)
    prose = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    text = prose(60)
    rows = [(1, " ".join(prose(70) + text + prose(70) + text + prose(70))), (2, " ".join(prose(20) + text))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in found) == [(1, 70, 60), (1, 200, 60), (2, 20, 60)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", "É", "Ab", "aB", " ", "\n", "\x0b", "\t", "\u2003", "xyz"]), max_size=40).map("".join), st.sampled_from([7, 1 << 20]))
def test_word_hashes_tell_words(text, chunk):
    old, passages.CHUNK = passages.CHUNK, chunk
    try:
        words, found = passages.words_of(text), passages.word_hashes(text).tolist()
    finally:
        passages.CHUNK = old
    assert len(found) == len(words)
    assert len(set(zip(words, found))) == len(set(words)) == len(set(found))


def test_grams_tell_runs():
    words = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for n in (1, 3, 5, 26):
        found, runs = passages.grams(words, n).tolist(), [tuple(words[k : k + n].tolist()) for k in range(400 - n + 1)]
        assert len(found) == len(runs) and len(set(zip(runs, found))) == len(set(runs)) == len(set(found))
    assert len(passages.grams(words[:2], 3)) == 0


def test_heavy_keys_give_the_same(spark, monkeypatch):
    rows, _, _ = corpus(5)
    rnd = random.Random(5)
    line = [f"v{k}" for k in range(40)]
    rows = [(i, t + " " + " ".join(line) + f" end{i} " + rnd.choice(["x ", "y "]) * 20) for i, t in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    normal = sorted(map(tuple, passages.repeated_passages(frame).collect()))
    monkeypatch.setattr(passages, "SAMPLE", 1)
    heavy = passages.heavy_keys(passages.texts(frame))
    assert len(heavy) and sorted(map(tuple, passages.repeated_passages(frame).collect())) == normal


def test_rows_that_share_a_doc_id(spark):
    rnd = random.Random(12)
    prose = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    one, two = prose(60), prose(70)
    rows = [(1, " ".join(prose(30) + one)), (1, " ".join(two)), (2, " ".join(one)), (3, " ".join(prose(90) + two + prose(9))), (3, " ".join(two)), (-4, " ".join(prose(7) + one))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_doc for r in found if r.n_words == 60} == {-4: -4, 1: -4, 2: -4}
    assert {r.doc_id: r.component_doc for r in found if r.n_words == 70} == {1: 1, 3: 1}


def brute_documents(rows):
    """Documents that share a run of over 50 equal words with another."""
    runs = collections.defaultdict(set)
    for i, t in rows:
        words = (t or "").lower().split()
        for k in range(len(words) - 50):
            runs[tuple(words[k : k + 51])].add(i)
    return {i for docs in runs.values() if len(docs) > 1 for i in docs}


def test_exact_repeats_equal_brute_force(spark):
    for seed in (21, 22):
        rnd = random.Random(seed)
        pool = [[f"p{rnd.randrange(60)}" for _ in range(rnd.randrange(10, 90))] for _ in range(25)]
        rows = [(i, " ".join(w for _ in range(rnd.randrange(5)) for w in rnd.choice(pool) + [f"u{rnd.randrange(10**6)}"] * rnd.randrange(2))) for i in range(80)]
        want = brute_documents(rows)
        found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        print("missed", len(want - found), "of", len(want))
        assert len(want) > 20 and want <= found


def test_small_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_documents([(r.doc_id, r.text) for r in docs.collect()])
    assert want and want <= {r.doc_id for r in passages.repeated_passages(docs).collect()}


def test_very_long_text(spark):
    long = [f"w{k}" for k in range(250_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["a", "b"] + long[199_000:199_100]))]
    found = sorted(map(tuple, passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_id").collect()))
    assert found == [(1, 199_000, 199_100, 100, 1, 199_000, True), (2, 2, 102, 100, 1, 199_000, False)]


def test_keys_of_a_text_do_not_depend_on_others():
    rows, _, _ = corpus(4)
    texts = ["", "one"] + [t for _, t in rows] + [""]
    together = passages.paragraph_keys(texts)
    for k in (0, 2, 5, len(texts) - 2):
        alone, own = passages.paragraph_keys([texts[k]]), together[1] == k
        for n in (0, 2, 3, 4):
            assert alone[n].tolist() == together[n][own].tolist()
