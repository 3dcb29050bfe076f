"""Operator 10: SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is 1 where over half of a document's shingle hashes have it.
Equal fingerprints form one class. The classes meet in buckets: with 64 bits cut
into blocks, two fingerprints within the radius agree in at least
``blocks - radius`` of them, so each choice of that many blocks keys one table
and no link can be missed. Buckets over ``cell`` members are cut again by their
remaining bits, so that no task gets a whole hot bucket.

Within a bucket the fingerprints stand in vertical bit planes, 64 to a machine
word. A breadth-first walk takes one fingerprint at a time and compares it with
all that are not yet reached: plane after plane the differing lanes are added
into carry-save counters, and a block is abandoned once every lane in it exceeds
the radius. Each bucket gives a forest of links, never all its pairs. Buckets of
few members are compared together, with a lane for each pair.

Edge cases: null and empty texts have no words and fingerprint zero, and link
like any other; fewer words than a shingle form one shingle; repeated rows (also
with one doc_id) share a class; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import prefixes
from kinfold.llm.arrow import bounded_batches, map_batches, texts, whole_groups
from kinfold.llm.pairs import paired_texts
from kinfold.llm.planes import SMALL, forest, proposed, small_links
from kinfold.operators.components import connected_components
from kinfold.operators.storage import scoped, written

SEED = 42
#: Members of a bucket that one task compares.
CELL = 2048


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype=np.uint64, count=len(found) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of shingle hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[lo : lo + (1 << 15)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits in a signed long."""

    def make(batch):
        fp = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(texts(df, id_col, text_col), make, f"doc_id {kind}, fp long")


def block_keys(fp: F.Column, blocks: int, radius: int) -> F.Column:
    """The keys of one fingerprint: a table number and the bits of its blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1)) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def links(classes: DataFrame, radius: int = 4, blocks: int = 6, cell: int = CELL) -> DataFrame:
    """Links (src, dst) that connect all fingerprints within the radius.

    ``classes`` has distinct fp (long) with an identifier rep (long). The links
    of a component span it; they are not all its pairs. A bucket of over ``cell``
    members is cut again: of ``radius + 1`` blocks of the bits that its key leaves
    open two fingerprints within the radius agree in one, so the finer buckets
    lose no link. Every fingerprint goes to a fixed number of them.
    """
    if not 0 <= radius < blocks or 64 // blocks * (blocks - radius) > 56:
        raise ValueError("blocks must exceed radius, and a key must fit in a long")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    used = F.array(*[F.lit(m - (m >> 63 << 64)) for m in masks])
    rows = classes.select("fp", "rep", F.posexplode(block_keys(F.col("fp"), blocks, radius)).alias("at", "key")).select("fp", "rep", "key", used[F.col("at")].alias("used"))
    found = None
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(64 - F.bit_count("used")).alias("open")).where("n > 1")
        sizes = sizes.select("key", ((F.col("n") > cell) & (F.col("open") >= 2 * (radius + 1))).alias("hot"))
        now = written(rows.join(sizes, "key"), "buckets")
        new = written(_compared(now.where("not hot").drop("hot", "used"), radius), "links")
        found = new if found is None else found.unionByName(new)
        hot = now.where("hot").drop("hot")
        if hot.isEmpty():
            return found.distinct()
        rows = hot.mapInArrow(_cut_again(radius), "fp long, rep long, key long, used long")


def _compared(buckets: DataFrame, radius: int) -> DataFrame:
    """(src, dst) by comparing the members of each bucket (key, fp, rep)."""

    def walk(batches):
        for batch, bounds in whole_groups(batches, ("key",)):
            fp, rep = batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
            starts, sizes = bounds[:-1], np.diff(bounds)
            few = (sizes > 1) & (sizes <= SMALL)
            x, y = small_links(fp, starts[few], sizes[few], radius)
            src, dst = [rep[x]], [rep[y]]
            for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                x, y = forest(fp[a : a + n], radius)
                src.append(rep[a : a + n][x])
                dst.append(rep[a : a + n][y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return bounded_batches(buckets.repartition("key").sortWithinPartitions("key")).mapInArrow(walk, "src long, dst long")


def _cut_again(radius: int):
    """Finer buckets: a key and a mask of used bits for each of ``radius + 1`` blocks."""

    def cut(batches):
        for batch in batches:
            fp, key, used = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "key", "used"))
            for mask in np.unique(used).tolist():
                at = np.flatnonzero(used == mask)
                left = [k for k in range(64) if not mask >> k & 1]
                for number in range(radius + 1):
                    own = sum(1 << k for k in left[len(left) * number // (radius + 1) : len(left) * (number + 1) // (radius + 1)])
                    finer = mixed_hashes(mixed_hashes(key[at], number + 1) ^ (fp[at] & np.uint64(own)), 1)
                    columns = (fp[at], batch.column("rep").to_numpy()[at], finer, np.full(len(at), mask | own, dtype=np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["fp", "rep", "key", "used"])

    return cut


@scoped
def near_duplicates(df: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id.

    The component is the smallest doc_id that links reach, itself included.
    """
    fps = written(fingerprints(df, words, id_col, text_col), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    parts = connected_components(links(classes, radius, blocks))
    root = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(root, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def mixed_hashes(hashes: np.ndarray, number: int) -> np.ndarray:
    """The hashes under another, independent hash function (0: as they are)."""
    if not number:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(number) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def jaccard(a: str, b: str, words: int) -> float:
    """Similarity of two texts' sets of shingles; 1 if both have none."""
    x, y = (np.unique(shingle_hashes(t, words)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A signed key for each band of ``rows`` MinHash values."""
    if not len(hashes):
        return [0] * bands
    seeds = mixed_hashes(np.arange(2 * bands * rows, dtype=np.uint64), 1).reshape(-1, 2)
    least = np.array([((hashes ^ a) * (b | np.uint64(1))).min() for a, b in seeds], dtype=np.uint64).reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(row.astype("<u8").tobytes(), k) for k, row in enumerate(least)], dtype=np.uint64).view(np.int64).tolist()


@scoped
def similar_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 60, prints: int = 3, bands: int = 12, rows: int = 5, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of documents whose shingle sets are alike.

    Documents meet in buckets of equal MinHash bands, a pair at similarity 0.8 in
    at least one of 12 with a chance of 0.99. Bit-sliced comparison proposes pairs
    whose fingerprints differ in at most ``radius`` of all 64 * ``prints`` bits
    (about 29 at similarity 0.8, 96 without any); a link counts if the exact Jaccard
    similarity of the two whole texts reaches ``similarity``.

    Members are held against the first of their bucket. Those of buckets that links
    have not joined by then meet once more by the rare shingles that any two sets
    so alike must share (``prefixes``), each pair of different groups is proposed,
    and so no link among them is missed. Nothing is proposed twice.

    Edge cases: rows without a doc_id are left out; rows that share one are one
    document, alike to another if any of their texts is; texts without words are
    alike; texts below ``words`` words are one shingle.
    """
    names = [f"fp{k}" for k in range(prints)]

    def make(batch):
        hashes = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
        return _prints(hashes, names) | {"doc_id": batch.column("doc_id"), "whole": [xxhash.xxh3_128_digest(np.unique(h).tobytes()) for h in hashes], "keys": [band_keys(h, bands, rows) for h in hashes]}

    docs = texts(df, id_col, text_col).where("doc_id is not null")
    fps = written(map_batches(docs, make, "doc_id long, whole binary, keys array<long>, " + ", ".join(f"{n} long" for n in names)), "fingerprints")
    classes = written(fps.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("keys", *names), "doc_id").alias("x")).select("whole", "rep", "x.*"), "classes")
    rows_of = classes.select("rep", *names, F.explode("keys").alias("key"))
    heads = rows_of.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", *names)).alias("head")).where("n > 1")
    members = written(rows_of.join(heads, "key"), "members")

    def verify(batch):
        pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        kept = batch.filter(pa.array([any(jaccard(x, y, words) >= similarity for x in a for y in b) for a, b in pairs], type=pa.bool_()))
        return {"src": kept.column("src"), "dst": kept.column("dst")}

    def verified(pairs: DataFrame) -> DataFrame:
        return written(map_batches(bounded_batches(paired_texts(docs, pairs)), verify, "src long, dst long"), "verified")

    tested = written(proposed(members.where(F.col("rep") != F.col("head.rep")), "head", names, radius), "proposed")
    held = verified(tested)
    parts = written(connected_components(held), "parts")
    grouped = lambda df: df.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    now = grouped(members.where("n > 2").select("rep", "key"))
    apart = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    still = written(now.join(apart, "key", "left_semi").select("rep").distinct(), "open")
    if not still.isEmpty():

        def sets(batch):
            hashes = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            grams = [np.unique(h).view(np.int64) for h in hashes]
            return _prints(hashes, names) | {"rep": batch.column("doc_id"), "sid": [xxhash.xxh64_intdigest(g.tobytes()) >> 1 for g in grams], "size": [len(g) for g in grams], "grams": grams}

        asked = docs.join(still.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
        postings = written(prefixes.postings(map_batches(bounded_batches(asked), sets, "rep long, sid long, size int, grams array<long>, " + ", ".join(f"{n} long" for n in names)), similarity, names), "postings")
        untested = lambda pairs: written(pairs.join(tested, ["src", "dst"], "left_anti"), "proposed")  # noqa: B023, E731
        for meet in (prefixes.with_first, prefixes.with_all):
            pairs = untested(meet(grouped(postings), similarity, names, radius, cell))
            tested, held = tested.unionByName(pairs), held.unionByName(verified(pairs))
            parts = written(connected_components(held), "parts")
    root = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("whole", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(root, "whole").select("doc_id", "component_id")


def _prints(hashes: list[np.ndarray], names: list[str]) -> dict[str, pa.Array]:
    """A column for each of several independent fingerprints."""
    return {n: pa.array(np.array([fingerprint(mixed_hashes(h, k)) for h in hashes], dtype=np.uint64).view(np.int64)) for k, n in enumerate(names)}
