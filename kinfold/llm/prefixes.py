"""Pairs of sets at a stated Jaccard similarity, by the rare elements they share.

With the elements of every set in one order, rarest first, two sets at similarity
``s`` share an element among the first ``size - ceil(s * size) + 1`` of each, its
prefix. Postings of the prefixes alone are kept, without elements that only one set
has. A shared element at places i and j leaves at most ``min(size - i, size' - j)``
elements in common, which is held against the overlap that the similarity asks for.
No pair is lost by either test.

A posting list whose sets are all of one component has nothing to tell. With the
others, first the set that has the element at its smallest place (the most common
one of its kind) is met by all, then, once these links are verified, every pair of
different components. Bit-sliced comparison of fingerprints follows in both.

Edge cases: a set of one element is its own prefix; empty sets have no postings;
equal sets of one ``rep`` are one set; an empty table has no postings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.arrow import bounded_batches, whole_groups
from kinfold.llm.planes import near_pairs, proposed, stacked

#: Against rounding in products of a similarity and a size.
SLACK = 1e-9


def postings(sets: DataFrame, similarity: float, names: list[str]) -> DataFrame:
    """(gram, pos, rep, sid, size, prints) of the prefixes of ``sets`` (rep, sid,
    size, grams, prints)."""
    one = sets.dropDuplicates(["rep", "sid"])
    each = one.select("rep", "sid", "size", *names, F.explode("grams").alias("gram"))
    often = one.select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count > 1")
    ordered = each.join(often, "gram", "left").groupBy("rep", "sid", "size", *names).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("n"), "gram"))).alias("x"))
    length = (F.col("size") - F.ceil(F.col("size") * similarity - SLACK) + 1).cast("int")
    found = ordered.select("rep", "sid", "size", *names, F.posexplode(F.slice("x", F.lit(1), length)).alias("pos", "y"))
    return found.where("y.n > 1").select(F.col("y.gram").alias("gram"), "pos", "rep", "sid", "size", *names)


def _undecided(rows: DataFrame) -> DataFrame:
    """The posting lists with sets of several components, and how long they are."""
    lists = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return rows.join(lists.select("gram", "n"), "gram")


def _needed(similarity: float, one, two):
    """Elements that two sets of these sizes share at least."""
    return (one + two) * (similarity / (1 + similarity)) - SLACK


def with_first(rows: DataFrame, similarity: float, names: list[str], radius: int, cell: int) -> DataFrame:
    """Distinct (src, dst) of each set and the first of its posting list; ``rows``
    are postings with comp."""
    first = rows.groupBy("gram").agg(F.min(F.struct("pos", "rep", "sid", "size", "comp", *names)).alias("head"), F.max("comp").alias("high"), F.min("comp").alias("low")).where("low < high")
    pairs = rows.join(first.select("gram", "head"), "gram").where("rep <> head.rep and comp <> head.comp")
    most = F.least(F.col("size") - F.col("pos"), F.col("head.size") - F.col("head.pos"))
    return proposed(pairs.where(most >= _needed(similarity, F.col("size"), F.col("head.size"))), "head", names, radius)


def with_all(rows: DataFrame, similarity: float, names: list[str], radius: int, cell: int) -> DataFrame:
    """Distinct (src, dst) of all sets of different components in a posting list.
    Lists of over ``cell`` are dealt over pairs of their parts."""
    parts = F.ceil(F.col("n") / cell).cast("int")
    dealt = _undecided(rows).withColumn("own", F.pmod(F.xxhash64("rep", "sid"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("gram", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "pos", "rep", "size", "comp", *names)

    def walk(batches):
        for batch, bounds in whole_groups(batches, ("gram", "p", "q")):
            yield from _met(batch, bounds, similarity, names, radius)

    cells = dealt.repartition("gram", "p", "q").sortWithinPartitions("gram", "p", "q")
    return bounded_batches(cells).mapInArrow(walk, "src long, dst long").distinct()


def _met(batch: pa.RecordBatch, bounds: np.ndarray, similarity: float, names: list[str], radius: int):
    """Pairs of the cells of a batch, in parts of bounded size."""
    p, q, own, pos, rep, size, comp = (batch.column(c).to_numpy() for c in ("p", "q", "own", "pos", "rep", "size", "comp"))
    prints = stacked([batch.column(n) for n in names])
    left, right, waiting = [], [], 0

    def tell():
        a, b = np.concatenate(left), np.concatenate(right)
        at = near_pairs(prints[a], prints[b], radius)
        ends = np.stack([np.minimum(rep[a[at]], rep[b[at]]), np.maximum(rep[a[at]], rep[b[at]])], axis=1)
        ends = np.unique(ends, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["src", "dst"])

    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start < 2 or comp[start:end].min() == comp[start:end].max():
            continue
        b = np.arange(start, end)
        for low in range(start, end, 64):
            a = np.arange(low, min(low + 64, end))
            ok = (comp[a, None] != comp[b]) & (a[:, None] < b) & (np.minimum((size - pos)[a, None], (size - pos)[b]) >= _needed(similarity, size[a, None], size[b]))
            if p[start] != q[start]:
                ok &= own[a, None] != own[b]
            x, y = np.nonzero(ok)
            if len(x):
                left.append(a[x])
                right.append(b[y])
                waiting += len(x)
                if waiting >= 1 << 17:
                    yield tell()
                    left, right, waiting = [], [], 0
    if waiting:
        yield tell()
