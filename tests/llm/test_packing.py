import collections
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfold.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_first_fit(lengths, size):
    free, bins = [], []
    for i, n in enumerate(lengths):
        place = next((b for b, f in enumerate(free) if f >= n), len(free))
        if place == len(free):
            free.append(size)
            bins.append([])
        free[place] -= n
        bins[place].append(i)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_tournament_is_first_fit_and_closing_loses_nothing(lengths):
    lengths = sorted(lengths, reverse=True)
    bins = packing.first_fit(lengths, 64)
    assert bins == plain_first_fit(lengths, 64)
    out = packing.closed(bins, lengths, 64)
    cover = collections.Counter((i, k) for b in out for i, a, n in b for k in range(a, a + n))
    assert cover == collections.Counter((i, k) for i, n in enumerate(lengths) for k in range(n))
    totals = [sum(n for _, _, n in b) for b in out]
    assert all(t == 64 or t & (t - 1) == 0 for t in totals)


def check(rows, found, size):
    tool = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in rows:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((i, len(ids), k, x) for k, x in enumerate(ids))
    have, bins = collections.Counter(), collections.defaultdict(list)
    for r in found:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        have.update((r.doc_id, r.doc_tokens, r.start + k, x) for k, x in enumerate(r.ids))
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)


def test_rows(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta", "<|endoftext|>", "zzz", "ü", "\n"], k=rnd.randint(0, 90)))) for i in range(80)] + [(90, None), (91, ""), (92, "same"), (92, "same"), (93, "long " * 500), (None, "no id")]
    found = packing.pack(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start long"), PATH, size=64, group=20, ids=True)
    check(rows, found.collect(), 64)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, PATH, ids=True).collect(), 1024)
    plain = packing.pack(docs, PATH).collect()
    assert sorted(map(tuple, plain)) == sorted(tuple(r)[:-1] for r in packing.pack(docs, PATH, ids=True).collect())
