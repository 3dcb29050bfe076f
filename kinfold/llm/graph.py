"""Operator 9: nearest neighbours by inner product over robust-pruned graphs.

Different vectors are dealt to shards by hash. In a shard a directed graph is
built: greedy searches from its medoid propose neighbours for a batch of nodes,
pruning with a relaxed distance keeps the diverse ones, reverse links are added
and pruned again. Inner product becomes Euclidean distance by one more
coordinate that gives all vectors the same length. Every query visits every
shard with a beam search; what the beam ends with is scored by the exact inner
product in double precision, and the shards' best are merged.

Equal vectors are one node with its smallest members: as a query returns at most
k rows and leaves out its own, k + 1 members of a node are all it can need.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; only vectors of one length are
compared; ties go to the smaller id; repeated rows count once; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.llm.vectors import matrix, packed
from kinfold.operators.storage import scoped, written

#: Vectors of a shard and queries of a visit on average.
SHARD, VISIT = 16384, 32768
DEGREE, SLACK, BUILD_BEAM, BEAM, RELAX, BATCH, WIDE, SEED = 24, 16, 40, 256, 1.2, 256, 4, 9


class Graph:
    """A directed graph over unit-bounded points (float32)."""

    def __init__(self, points: np.ndarray, links: np.ndarray | None = None, start: int = 0) -> None:
        self.x = np.ascontiguousarray(points, dtype=np.float32)
        self.norm = (self.x * self.x).sum(1)
        if links is not None:
            self.links, self.start = links, start
            return
        n, random = len(points), np.random.default_rng(SEED)
        self.start = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())
        self.links = np.full((n, DEGREE + SLACK), -1, dtype=np.int32)
        if n <= DEGREE + 1:
            for i in range(n):
                own = np.delete(np.arange(n), i)
                self.links[i, : len(own)] = own
            return
        some = DEGREE // 2
        self.links[:, :some] = random.integers(0, n - 1, (n, some))
        self.links[:, :some] += self.links[:, :some] >= np.arange(n)[:, None]
        for relax in (1.0, RELAX):
            order = random.permutation(n)
            for lo in range(0, n, BATCH):
                self._insert(order[lo : lo + BATCH], relax)
        self._reach()

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and squared distances of each query's beam."""
        q, n = len(queries), len(self.x)
        beam = min(beam, n)
        node = np.full((q, beam), -1, dtype=np.int64)
        far = np.full((q, beam), np.inf, dtype=np.float32)
        node[:, 0], far[:, 0] = self.start, self._far(queries, np.full((q, 1), self.start))[:, 0]
        done = np.zeros((q, beam), dtype=bool)
        seen = np.zeros((q, n + 1), dtype=bool)
        seen[:, self.start] = seen[:, n] = True
        row = np.arange(q)[:, None]
        while True:
            rank = np.where(done | (node < 0), np.inf, far)
            pick = np.argpartition(rank, min(WIDE, beam) - 1, axis=1)[:, :WIDE] if beam > WIDE else np.argsort(rank, axis=1)
            open_ = np.isfinite(np.take_along_axis(rank, pick, 1))
            busy = np.flatnonzero(open_.any(1))
            if not len(busy):
                return node, far
            pick, open_, at = pick[busy], open_[busy], busy[:, None]
            done[at, pick] |= open_
            near = np.where(open_[:, :, None], self.links[np.where(open_, node[at, pick], 0)], -1).reshape(len(busy), -1).astype(np.int64)
            near[near < 0] = n
            near.sort(axis=1)
            new = ~seen[at, near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[at, near] = True
            width = int(new.sum(1).max())
            if not width:
                continue
            front = np.argsort(~new, axis=1, kind="stable")[:, :width]
            near, new = np.take_along_axis(near, front, 1), np.take_along_axis(new, front, 1)
            more = np.where(new, self._far(queries[busy], np.where(new, near, 0)), np.inf).astype(np.float32)
            all_node = np.concatenate([node[busy], np.where(new, near, -1)], 1)
            all_far = np.concatenate([far[busy], more], 1)
            all_done = np.concatenate([done[busy], np.zeros_like(new)], 1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            node[busy], far[busy], done[busy] = (np.take_along_axis(a, best, 1) for a in (all_node, all_far, all_done))
        return node, far

    def _far(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        dots = np.matmul(self.x[nodes], queries[:, :, None])[:, :, 0]
        return np.maximum((queries * queries).sum(1)[:, None] - 2 * dots + self.norm[nodes], 0)

    def _insert(self, nodes: np.ndarray, relax: float) -> None:
        found, _ = self.search(self.x[nodes], BUILD_BEAM)
        self.links[nodes] = self._prune(nodes, np.concatenate([found, self.links[nodes]], 1), relax)
        to = self.links[nodes].ravel().astype(np.int64)
        source = np.repeat(nodes, self.links.shape[1])[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(node), BATCH):
            own, a, c = node[lo : lo + BATCH], first[lo : lo + BATCH], count[lo : lo + BATCH]
            more = np.full((len(own), int(c.max())), -1, dtype=np.int64)
            place = np.arange(more.shape[1])[None, :] < c[:, None]
            more[place] = source[a[0] : a[-1] + c[-1]]
            near = np.concatenate([self.links[own], more], 1)
            near = -np.sort(-near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = -np.sort(-near, axis=1)
            full = (near >= 0).sum(1) > self.links.shape[1]  # only these are pruned again
            self.links[own[~full]] = near[~full, : self.links.shape[1]]
            if full.any():
                self.links[own[full]] = self._prune(own[full], near[full], relax)

    def _prune(self, nodes: np.ndarray, near: np.ndarray, relax: float) -> np.ndarray:
        """Diverse neighbours: a candidate goes if one chosen is much nearer to it."""
        near = np.sort(np.where(near == nodes[:, None], -1, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        far = np.where(near >= 0, self._far(self.x[nodes], np.maximum(near, 0)), np.inf)
        width = min(near.shape[1], 3 * DEGREE)
        front = np.argsort(far, axis=1)[:, :width]
        near, far = np.take_along_axis(near, front, 1), np.take_along_axis(far, front, 1)
        x = self.x[np.maximum(near, 0)]
        norm = self.norm[np.maximum(near, 0)]
        between = norm[:, :, None] - 2 * np.matmul(x, x.transpose(0, 2, 1)) + norm[:, None, :]
        alive, row = near >= 0, np.arange(len(nodes))
        out = np.full((len(nodes), self.links.shape[1]), -1, dtype=np.int32)
        for k in range(DEGREE):
            best = alive.argmax(1)  # candidates stand by distance
            has = alive[row, best]
            if not has.any():
                break
            out[has, k] = near[row, best][has]
            gone = relax * relax * between[row, best] <= far
            gone[row, best] = True
            alive &= ~(gone & has[:, None])
        return out

    def _reach(self) -> None:
        """Link nodes that no path from the start leads to."""
        n = len(self.x)
        seen = np.zeros(n, dtype=bool)
        front = np.array([self.start])
        while True:
            while len(front):
                seen[front] = True
                front = np.unique(self.links[front])
                front = front[front >= 0]
                front = front[~seen[front]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            there = np.flatnonzero(seen)
            host = there[self._far(self.x[lost[:1]], there[None, :])[0].argmin()]
            if (self.links[host] >= 0).all():  # another column keeps what the host has
                self.links = np.concatenate([self.links, np.full((n, 1), -1, dtype=np.int32)], 1)
            self.links[host, np.flatnonzero(self.links[host] < 0)[0]] = lost[0]
            front = lost[:1]


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    scaled = rows / longest
    return np.concatenate([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(1), 0))[:, None]], 1).astype(np.float32)


@scoped
def nearest(df: DataFrame, is_query: F.Column, k: int = 20, shard: int = SHARD, beam: int = BEAM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query its ``k`` nearest: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the column vec_id.
    """
    rows = written(packed(df, id_col, vec_col).where("vec is not null and vec_id is not null"), "vectors")
    # members of a node: the smallest ids of each salt first, so that no task gets all of a frequent vector
    ids = rows.select("digest", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    least = ids.withColumn("r", F.row_number().over(W.partitionBy("digest", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    least = least.withColumn("r", F.row_number().over(W.partitionBy("digest").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = least.groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    nodes = rows.groupBy("digest").agg(F.first("vec").alias("vec")).join(members, "digest")
    nodes = written(nodes.withColumn("size", F.octet_length("vec")), "nodes")

    def longest(batches):
        for batch in batches:
            data = [np.frombuffer(v, "<f8") for v in batch.column("vec").to_pylist()]
            if data:
                most = max(float((m := np.abs(v).max()) * np.sqrt(((v / m) ** 2).sum())) for v in data)
                yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    stats = nodes.select("vec").mapInArrow(longest, "most double").agg(F.max("most").alias("most")).first()
    most, count = stats["most"] or 1.0, nodes.count()
    shards = max(1, math.ceil(count / shard))

    def build(group: pa.Table) -> pa.Table:
        graph = Graph(_lifted(matrix(group.column("vec")), most))
        lists = group.column("members").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        return pa.table({
            "size": group.column("size")[:1], "shard": group.column("shard")[:1], "start": pa.array([graph.start], pa.int32()), "degree": pa.array([graph.links.shape[1]], pa.int32()),
            "vecs": pa.array([b"".join(group.column("vec").to_pylist())], pa.binary()), "links": pa.array([graph.links.astype("<i4").tobytes()], pa.binary()),
            "counts": pa.array([pa.compute.list_value_length(lists).to_numpy().astype("<i4").tobytes()], pa.binary()), "ids": pa.array([lists.flatten().to_numpy().astype("<i8").tobytes()], pa.binary()),
        })

    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    graphs = written(placed.groupBy("size", "shard").applyInArrow(build, "size int, shard int, start int, degree int, vecs binary, links binary, counts binary, ids binary"), "graphs")

    asking = rows.where(is_query).select("vec_id", "digest")
    asked = written(nodes.join(asking.select("digest").distinct(), "digest", "left_semi").select("digest", "vec", "size"), "asked")
    visits = max(1, math.ceil(asked.count() / VISIT))
    dealt = asked.withColumn("visit", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(visits)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    hosts = graphs.withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(visits - 1))))

    def visit(host: pa.Table, guests: pa.Table) -> pa.Table:
        out: dict[str, list] = {"digest": [], "vec_id": [], "score": []}
        if host.num_rows and guests.num_rows:
            g = host.to_pylist()[0]
            vecs = np.frombuffer(g["vecs"], "<f8").reshape(-1, g["size"] // 8)
            graph = Graph(_lifted(vecs, most), np.frombuffer(g["links"], "<i4").reshape(len(vecs), g["degree"]), g["start"])
            counts, ids = np.frombuffer(g["counts"], "<i4"), np.frombuffer(g["ids"], "<i8")
            first = np.concatenate([[0], np.cumsum(counts)])
            queries, names = matrix(guests.column("vec")), guests.column("digest").to_pylist()
            for lo in range(0, len(queries), BATCH):
                part = queries[lo : lo + BATCH]
                flat = np.concatenate([part / np.abs(part).max(1, keepdims=True), np.zeros((len(part), 1))], 1)
                flat /= np.sqrt((flat * flat).sum(1, keepdims=True))
                found, _ = graph.search(flat.astype(np.float32), max(beam, k + 1))
                for q, near, name in zip(part, found, names[lo : lo + BATCH], strict=True):
                    near = near[near >= 0]
                    score = vecs[near] @ q
                    who = np.concatenate([ids[first[i] : first[i + 1]] for i in near])
                    score = np.repeat(score, counts[near])
                    best = np.lexsort((who, -score))[: k + 1]
                    out["digest"].extend([name] * len(best))
                    out["vec_id"].append(who[best])
                    out["score"].append(score[best])
        flat = [np.concatenate(out[c]) if out[c] else np.empty(0, t) for c, t in (("vec_id", np.int64), ("score", np.float64))]
        return pa.table({"digest": pa.array(out["digest"], pa.binary()), "vec_id": flat[0], "score": flat[1]})

    answers = hosts.groupBy("size", "shard", "visit").cogroup(dealt.groupBy("size", "shard", "visit")).applyInArrow(visit, "digest binary, vec_id long, score double")
    ranked = answers.withColumn("r", F.row_number().over(W.partitionBy("digest").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    own = asking.distinct().join(lists, "digest").select(F.col("vec_id").alias("query_id"), "best")
    others = own.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("p", "x"))
    return others.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
