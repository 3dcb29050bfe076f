"""Hierarchical grouping: complete-link duplicates, average-link clusters.

Neither merge ever crosses a connected component of the graph of close pairs, so
both run as one grouped map for each component. Rows of a component meet in one
task because their merge order matters; everything else stays distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import is_usable, unit
from kinfold.operators.components import connected_components
from kinfold.operators.pairs import cosine_edges, matrix
from kinfold.operators.storage import written
from kinfold.options import GroupingError


def _with_parts(edges: DataFrame) -> DataFrame:
    parts = connected_components(edges)
    return edges.join(parts.select(F.col("node").alias("src"), "component"), "src")


def greedy_complete_link(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Group (by its first member) of every node of ``edges``.

    Pairs are tried in lexicographic order; two groups merge only if all pairs
    between them are edges.
    """
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    owner = {n: n for n in near}
    members = {n: {n} for n in near}
    common = {n: set(near[n]) for n in near}  # what all members of a group are close to
    for a, b in sorted((min(e), max(e)) for e in edges):
        one, two = sorted((owner[a], owner[b]))
        if one != two and members[two] <= common[one]:
            for n in members[two]:
                owner[n] = one
            members[one] |= members.pop(two)
            common[one] &= common.pop(two)
    return owner


def require_partition(nodes: DataFrame, groups: DataFrame, key: str = "rel_path") -> None:
    """Raise unless ``groups`` has every key of ``nodes`` exactly once and no other."""
    held = groups.groupBy(key).agg(F.count("*").alias("held"))
    odd = nodes.select(key).distinct().withColumn("asked", F.lit(1)).join(held, key, "full").where("asked is null or held is null or held <> 1")
    first = odd.select(key, "asked", F.coalesce("held", F.lit(0)).alias("held")).limit(1).collect()
    if first:
        raise GroupingError(f"{first[0][0]} is in {first[0]['held']} groups" + ("" if first[0]["asked"] else " but not among the rows"))


def complete_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rel_path, dup_group): every node's group, named by its first member."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        owner = greedy_complete_link(list(zip(pdf.src, pdf.dst, strict=True)))
        return pd.DataFrame({"rel_path": list(owner), "dup_group": list(owner.values())})

    edges = written(edges.select("src", "dst"), "dup-edges")
    merged = _with_parts(edges).groupBy("component").applyInPandas(merge, "rel_path string, dup_group string")
    return nodes.select("rel_path").join(merged, "rel_path", "left").select("rel_path", F.coalesce("dup_group", "rel_path").alias("dup_group"))


def mean_vectors(rows: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, mean, n): element-wise means. The mean of one vector is the vector; only
    groups of several are taken apart, and summed before the shuffle."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    sized = rows.select(by, F.col(vec).cast("array<double>").alias("mean")).join(sizes, by)
    flat = sized.where("n > 1").select(by, F.posexplode("mean").alias("k", "x"))
    sums = flat.groupBy(by, "k").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    several = sums.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("n"))
    return sized.where("n = 1").unionByName(several)


def representatives(rows: DataFrame, by: str = "dup_group", vec: str = "v") -> DataFrame:
    """(by, v): each group's unit mean of unit vectors; a zero mean is an error."""
    means = written(mean_vectors(rows.withColumn(vec, unit(F.col(vec))), by, vec), "means")
    zero = means.where(F.forall("mean", lambda x: x == 0)).select(by).limit(1).collect()
    if zero:
        raise GroupingError(f"the group of {zero[0][0]} has a zero mean and no cosine representative")
    return means.select(by, unit(F.col("mean")).alias("v"))


def average_link(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of average-link clusters of unit rows; merges below the threshold. A
    label is the cluster's first row.

    A nearest-neighbour chain finds the merges in quadratic time. Average linkage
    is monotone, so cutting its merges by height gives the tree's cut. As the mean
    distance of two groups is one minus the product of their mean vectors, only the
    sums of the groups are held, and no distance but those of the chain's end.
    """
    n = len(vectors)
    sums, size, number = vectors.astype(np.float64), np.ones(n), np.arange(n)
    place = np.arange(n)  # of each group in sums, which closes its gaps
    owner, chain, held = np.arange(n), [], n
    for _ in range(n - 1):
        if not chain:
            chain = [int(number[0])]
        while True:
            at = place[chain[-1]]
            far = np.clip(1.0 - (sums[:held] @ (sums[at] / size[at])) / size[:held], 0.0, 2.0)
            far[at] = np.inf
            to = int(far.argmin())
            if len(chain) > 1 and far[place[chain[-2]]] <= far[to]:
                to = int(place[chain[-2]])
                break
            chain.append(int(number[to]))
        height = far[to]
        del chain[-2:]
        one, two = sorted((int(at), to), key=lambda k: number[k])
        if height < threshold:
            owner[number[two]] = number[one]
        sums[one] += sums[two]
        size[one] += size[two]
        held -= 1  # the last group takes the place of the second
        sums[two], size[two], number[two] = sums[held], size[held], number[held]
        place[number[two]] = two
        number = number[:held]
    while (owner != owner[owner]).any():
        owner = owner[owner]
    return owner


def linked_average(vectors: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray, threshold: float) -> np.ndarray:
    """The same labels from all pairs a < b whose distance ``far`` is under the threshold.

    The mean distance of a merged group is between those of its halves, so a pair of
    groups under the threshold descends from such a pair, and only those are held.
    Pairs that are each other's nearest merge in any order: all of a round at once.
    Equal distances go by the first members, as if pairs were merged one by one.
    """
    n = len(vectors)
    sums, size, owner = vectors.astype(np.float64), np.ones(n), np.arange(n)
    codes = a.astype(np.int64) * n + b
    order = np.argsort(codes, kind="stable")
    codes, far = codes[order], far[order]
    while len(codes):
        a, b = codes // n, codes % n
        least, first = np.full(n, np.inf), np.full(n, len(codes))
        for end in (a, b):
            np.minimum.at(least, end, far)
        for end in (a, b):
            at = np.flatnonzero(far == least[end])
            np.minimum.at(first, end[at], at)
        at = np.flatnonzero((first[a] == np.arange(len(a))) & (first[b] == np.arange(len(b))))
        one, two = a[at], b[at]
        sums[one] += sums[two]
        size[one] += size[two]
        owner[two] = one
        touched = np.zeros(n, dtype=bool)
        touched[one] = touched[two] = True
        changed = touched[a] | touched[b]
        a, b = owner[a[changed]], owner[b[changed]]
        new = np.unique((np.minimum(a, b) * n + np.maximum(a, b))[a != b])
        own = np.empty(len(new))
        for start in range(0, len(new), PAIRS):
            x, y = new[start : start + PAIRS] // n, new[start : start + PAIRS] % n
            own[start : start + PAIRS] = 1.0 - np.einsum("ij,ij->i", sums[x], sums[y]) / (size[x] * size[y])
        own = np.clip(own, 0.0, 2.0)
        codes, far = np.concatenate([codes[~changed], new[own < threshold]]), np.concatenate([far[~changed], own[own < threshold]])
        order = np.argsort(codes, kind="stable")
        codes, far = codes[order], far[order]
    while (owner != owner[owner]).any():
        owner = owner[owner]
    return owner


#: Pairs of groups whose distances are computed at a time.
PAIRS = 1 << 16
#: Close pairs for each vector up to which they are stored; beyond, a chain without them
#: gives the same clusters. Rows that this is judged by.
CLOSE, JUDGED = 256, 2048
#: No cosine distance is above.
FARTHEST = 2.0


def _many_close(reps: DataFrame, threshold: float) -> bool:
    """Whether pairs under the threshold are too many to store, judged by those of some
    rows. It chooses the way, not the result."""
    n = reps.count()
    share = F.pmod(F.xxhash64("dup_group", F.lit(1)), F.lit(max(1, n // JUDGED))) == 0
    some = reps.where(share).select(F.col("dup_group").alias("key"), "v")
    held = some.count()
    return cosine_edges(some, threshold).count() * (n / max(1, held)) ** 2 > CLOSE * n


def average_link_clusters(reps: DataFrame, threshold: float) -> DataFrame:
    """(dup_group, cluster_key): clusters of representatives under the cut.

    ``reps`` has dup_group and unit v. The key is the cluster's first member. Rows and
    close pairs of a connected component meet in one task; where close pairs are very
    many, all rows do, without pairs. A vector that is null, zero or not finite stays
    alone, unless the cut is beyond all distances: then there is one cluster.
    """
    reps = reps.select("dup_group", F.col("v").cast("array<double>").alias("v"))
    if threshold > FARTHEST:
        return reps.select("dup_group").join(F.broadcast(reps.agg(F.min("dup_group").alias("cluster_key"))))
    usable = reps.where(is_usable(F.col("v")))
    kind = "dup_group string, cluster_key string"

    def named(names: pa.ChunkedArray, order: np.ndarray, label: np.ndarray) -> pa.Table:
        names = names.combine_chunks().take(pa.array(order))
        return pa.table({"dup_group": names, "cluster_key": names.take(pa.array(label))})

    def chained(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows.column("dup_group")).to_numpy()
        return named(rows.column("dup_group"), order, average_link(matrix(rows.column("v"))[order], threshold))

    def joined(rows: pa.Table, edges: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows.column("dup_group")).to_numpy()
        names = rows.column("dup_group").combine_chunks().take(pa.array(order))
        a, b = (pc.index_in(edges.column(c), value_set=names).to_numpy() for c in ("src", "dst"))
        label = linked_average(matrix(rows.column("v"))[order], a, b, edges.column("distance").to_numpy(), threshold)
        return named(rows.column("dup_group"), order, label)

    if _many_close(usable, threshold):
        grouped = usable.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(chained, kind)
    else:
        edges = written(cosine_edges(usable.select(F.col("dup_group").alias("key"), "v"), threshold), "cosine-edges")
        parts = written(connected_components(edges.select("src", "dst")), "parts")
        part = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias("part"))
        members, linked = usable.join(part("dup_group"), "dup_group"), edges.join(part("src"), "src")
        grouped = members.groupBy("part").cogroup(linked.groupBy("part")).applyInArrow(joined, kind)
    return reps.select("dup_group").join(grouped, "dup_group", "left").select("dup_group", F.coalesce("cluster_key", "dup_group").alias("cluster_key"))
