"""Operator 7: reversible line dedup over sharded cuckoo filters.

A line's key is a 128-bit hash of the line stripped at both ends with A-Z
folded. An index holds the references (key, document) as rows, and for each shard
of keys a cuckoo filter with one entry for each key. Documents come in batches. A
key that stands once in a batch and that the filter does not know is new: it needs
no look at the references. Keys that a filter admits, and those of several
documents of a batch, are looked up and counted exactly. A filter never denies a key it holds; one that ran full admits every key.

Documents can be inserted and deleted at any time: a key leaves its filter when
its last reference goes, so every dedup decision can be undone.

A shard sees each key of a batch once, with the number of its documents, so a very
frequent line weighs no more than others; references are counted by aggregation
before they are shuffled.

Edge cases: a null or empty text is one empty line; rows that share a doc_id are
one document for the counts, and each loses the same lines; rows without a
doc_id are not counted and stay whole; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.arrow import bounded_batches, map_batches, texts
from kinfold.operators.storage import scoped, written

SPACES = " \t\n\x0b\x0c\r"
#: Keys that a shard is laid out for, and least number of shards.
SHARD_KEYS, LEAST_SHARDS = 65536, 16
#: Batches that the documents of one table are inserted in.
BATCHES = 3
KEYS = ["h1", "h2"]


def line_key(line: str, least: int) -> bytes | None:
    """The 128-bit key of a line; None if it is too short to count."""
    bare = line.strip(SPACES)
    if len(bare) < least:
        return None
    return hashlib.blake2b(bare.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


class CuckooFilter:
    """Two buckets of four 16-bit marks for each key. One that a key found no room in
    is full: it has no table any more and may hold every key."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 64, state: bytes | None = None) -> None:
        if state is None:
            self.table = np.zeros((1 << max(4, int(capacity / self.SLOTS / 0.85)).bit_length(), self.SLOTS), dtype=np.uint16)
        else:
            self.table = np.frombuffer(state, dtype=np.uint16).reshape(-1, self.SLOTS).copy()
        self.random = np.random.default_rng(7)

    @property
    def full(self) -> bool:
        return not len(self.table)

    def state(self) -> bytes:
        """The table, as the constructor takes it."""
        return self.table.tobytes()

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (h2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = h1.view(np.uint64) & mask
        return mark, one, one ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(3)) & np.uint64(len(self.table) - 1)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys may be held; False is certain."""
        if self.full:
            return np.ones(len(h1), dtype=bool)
        mark, one, two = self._places(h1, h2)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Add one entry for each key."""
        if self.full:
            return
        mark, one, two = self._places(h1, h2)
        left = np.arange(len(mark))
        for side in (one, two):  # first all that fit without moving others
            while len(left):
                bucket = side[left]
                order = np.argsort(bucket, kind="stable")
                first = order[np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])]
                free = self.table[bucket[first]] == 0
                fits = free.any(1)
                if not fits.any():
                    break
                chosen = left[first[fits]]
                self.table[side[chosen], free[fits].argmax(1)] = mark[chosen]
                left = np.setdiff1d(left, chosen, assume_unique=True)
        if not all(self._kick(int(two[i]), int(mark[i])) for i in left):
            self.table = self.table[:0]

    def _kick(self, bucket: int, mark: int) -> bool:
        for _ in range(self.KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
            slot = int(self.random.integers(self.SLOTS))
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= int(self._jump(np.array([mark], dtype=np.uint16))[0])
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove one entry for each key, all of which must be held."""
        if self.full:
            return
        for mark, *places in zip(*self._places(h1, h2), strict=True):
            for bucket in places:
                slot = np.flatnonzero(self.table[bucket] == mark)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break


def references(df: DataFrame, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc_id): the keys of each document, once each."""

    def make(batch):
        keys, owners = [], []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = {k for line in text.split("\n") if (k := line_key(line, least))}
            keys.extend(own)
            owners.extend([i] * len(own))
        if keys:
            pair = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield {"h1": pa.array(pair[:, 0].copy()), "h2": pa.array(pair[:, 1].copy()), "doc_id": owners}

    return map_batches(texts(df, id_col, text_col).where("doc_id is not null"), make, "h1 long, h2 long, doc_id long")


def _shard(shards: int) -> F.Column:
    return F.pmod(F.shiftright("h1", 20), F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class LineIndex:
    """The references of a growing corpus and the filters over their keys.

    ``refs`` (h1, h2, doc_id), ``admitted`` (h1, h2: keys that have had several
    references) and ``filters`` (shard, filter) are stored tables; each change gives
    a new index. ``keys`` bounds the number of keys that the filters hold.
    """

    refs: DataFrame
    admitted: DataFrame
    filters: DataFrame
    shards: int
    keys: int = 0
    make: type = CuckooFilter

    @classmethod
    def empty(cls, spark, expected: int = 0, make: type = CuckooFilter) -> LineIndex:
        """An index without references, laid out for so many keys."""
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(none("h1 long, h2 long, doc_id long"), none("h1 long, h2 long"), none("shard int, filter binary"), max(LEAST_SHARDS, -(-expected // SHARD_KEYS)), make=make)

    def insert(self, refs: DataFrame, new_documents: bool = False) -> LineIndex:
        """The index with more references; those it holds already change nothing.
        With ``new_documents`` none of them is of a document that it holds."""
        refs = written(refs.select(*KEYS, "doc_id").distinct(), "line-refs")
        own = written(refs.groupBy(*KEYS).agg(F.count("*").alias("n")), "line-keys")
        index = self if self.keys + (more := own.count()) <= self.shards * SHARD_KEYS else self._laid_out(self.keys + more)
        # only what the filters admit is looked up; what proves new there gets an entry of its own
        held = written(index._known(own).join(index.refs, KEYS, "left_semi"), "line-known")
        filters = index._changed(own.join(held, KEYS, "left_anti"), "insert")
        admitted = written(index.admitted.unionByName(held).unionByName(own.where("n > 1").select(*KEYS)).distinct(), "line-admitted")
        if not new_documents:
            seen = refs.join(held, KEYS, "left_semi").join(index.refs, [*KEYS, "doc_id"], "left_semi")
            refs = written(refs.join(seen, [*KEYS, "doc_id"], "left_anti"), "line-refs")
        return replace(index, refs=index.refs.unionByName(refs), admitted=admitted, filters=filters, keys=index.keys + more)

    def delete(self, refs: DataFrame) -> LineIndex:
        """The index without these references."""
        refs = refs.select(*KEYS, "doc_id").distinct()
        gone = self.refs.join(refs, [*KEYS, "doc_id"], "left_semi")
        left = written(self.refs.join(refs, [*KEYS, "doc_id"], "left_anti"), "line-refs")
        lost = gone.select(*KEYS).distinct().join(left, KEYS, "left_anti")
        return replace(self, refs=left, filters=self._changed(lost, "delete"))

    def _laid_out(self, keys: int) -> LineIndex:
        """The same references with filters for twice so many keys."""
        index = replace(self, filters=self.filters.limit(0), shards=max(LEAST_SHARDS, -(-2 * keys // SHARD_KEYS)))
        return replace(index, filters=index._changed(self.refs.select(*KEYS).distinct(), "insert"))

    def _with_filters(self, keys: DataFrame, function, schema: str) -> DataFrame:
        """Each shard's filter (a row, or none) and its distinct keys in one call."""
        return self.filters.groupBy("shard").cogroup(keys.select(*KEYS, _shard(self.shards)).groupBy("shard")).applyInArrow(function, schema)

    def _known(self, keys: DataFrame) -> DataFrame:
        """Those of distinct keys that the filters may hold."""
        make = self.make

        def ask(old: pa.Table, new: pa.Table) -> pa.Table:
            own = new.select(KEYS)
            if not old.num_rows:
                return own.slice(0, 0)
            return own.filter(pa.array(make(state=old.column("filter")[0].as_py()).contains(*(own.column(c).to_numpy() for c in KEYS))))

        return self._with_filters(keys, ask, "h1 long, h2 long")

    def _changed(self, keys: DataFrame, how: str) -> DataFrame:
        """The filters after distinct keys went in or out."""
        make, room = self.make, int(1.5 * SHARD_KEYS)

        def change(old: pa.Table, new: pa.Table) -> pa.Table:
            own = make(state=old.column("filter")[0].as_py()) if old.num_rows else make(room)
            getattr(own, how)(*(new.column(c).to_numpy() for c in KEYS))
            return pa.table({"shard": (old if old.num_rows else new).column("shard")[:1], "filter": pa.array([own.state()], pa.binary())})

        return written(self._with_filters(keys, change, "shard int, filter binary"), "line-filters")

    def drops(self, least: int = 3) -> DataFrame:
        """(h1, h2, doc_id) of the lines to drop at present."""
        held = self.refs.join(self.admitted, KEYS, "left_semi")
        often = written(held.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= least), "line-counts")
        return held.join(often, KEYS).where("doc_id <> top").select(*KEYS, "doc_id")


def dropped_keys(refs: DataFrame, least: int = 3, make: type = CuckooFilter) -> DataFrame:
    """(h1, h2, doc_id) to drop: the documents of ``refs``, a stored table, go into an
    index batch by batch."""
    index = LineIndex.empty(refs.sparkSession, refs.count(), make)
    for k in range(BATCHES):
        index = index.insert(refs.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == k), new_documents=True)
    return index.drops(least)


@scoped
def dedup_lines(df: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, text (the lines that stay), and the
    columns ``carry`` with ``_`` before their names, so that none clashes.

    Keys of at least ``least_chars`` code points in at least ``least_docs``
    documents lose all their lines except in the largest doc_id that has them.
    """
    drops = dropped_keys(written(references(df, least_chars, id_col, text_col), "line-refs"), least_docs)
    own = drops.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))
    docs = bounded_batches(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"_{c}") for c in carry])
    joined = docs.join(own.hint("shuffle_hash"), "doc_id", "left")

    def rewrite(batch):
        pairs = batch.column("drops")
        flat = pairs.flatten()
        keys = np.stack([flat.field("h1").to_numpy(), flat.field("h2").to_numpy()], 1).astype("<i8") if len(flat) else np.empty((0, 2), "<i8")
        sizes = [n or 0 for n in pa.compute.list_value_length(pairs).to_pylist()]
        out = {"doc_id": batch.column("doc_id"), "n_lines": [], "n_dropped": [], "text": []} | {f"_{c}": batch.column(f"_{c}") for c in carry}
        at = 0
        for i, text, n in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), sizes, strict=True):
            gone = {k.tobytes() for k in keys[at : at + n]}
            at += n
            lines = text.split("\n")
            kept = [x for x in lines if line_key(x, least_chars) not in gone] if gone else lines
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
            out["text"].append("\n".join(kept))
        yield out

    kinds = dict(docs.dtypes)
    return map_batches(joined, rewrite, ", ".join([f"doc_id {kinds['doc_id']}", "n_lines long", "n_dropped long", "text string", *(f"`_{c}` {kinds[f'_{c}']}" for c in carry)]))


def digest(kept: DataFrame) -> DataFrame:
    """The contract's columns: counts and a hash of the text that stays."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
