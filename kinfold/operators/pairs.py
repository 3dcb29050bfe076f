"""Joins of a relation with itself: Hamming pairs by block keys, cosine blocks."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.hashes import BLOCK_PAIRS, block_pair, first_agreement, hamming
from kinfold.functions.vectors import is_usable
from kinfold.operators.storage import written
from kinfold.options import MAX_ASPECT, MAX_HAMMING, MAX_THUMB_ERROR, GroupingError


def hamming_pairs(rows: DataFrame, key: str, hash_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, distance, src_*, dst_*) with src < dst at Hamming distance 4 or
    less: an equi-join on pairs of blocks instead of a nested loop.

    Rows of one hash are one class, and only classes meet: of six blocks two hashes
    so near agree in two at least, so 15 keys of 20 to 22 bits lose none. A pair that
    agrees in several keys is kept at the first of them, so no distinct is needed.
    The rows of two near classes are joined at the end: they are the result.
    """
    stored = written(rows.select(F.col(key).alias("key"), F.col(hash_col).alias("hash"), *carry), "hashes")
    keys = F.array(*[block_pair(F.col("hash"), a, b) for a, b in BLOCK_PAIRS])
    side = lambda name: stored.select("hash").distinct().select(F.col("hash").alias(name), F.posexplode(keys).alias("number", "bits"))
    near = side("one").join(side("two"), ["number", "bits"]).where((F.col("one") < F.col("two")) & (hamming(F.col("one"), F.col("two")) <= MAX_HAMMING) & (F.col("number") == first_agreement(F.col("one"), F.col("two"))))
    near = near.select("one", "two").unionByName(stored.groupBy("hash").count().where("count > 1").select(F.col("hash").alias("one"), F.col("hash").alias("two")))
    row = lambda name, end: stored.select(F.col("hash").alias(name), F.col("key").alias(f"{end}_key"), *[F.col(c).alias(f"{end}_{c}") for c in carry])
    met = near.join(row("one", "a"), "one").join(row("two", "b"), "two").where((F.col("one") != F.col("two")) | (F.col("a_key") < F.col("b_key")))
    first = F.col("a_key") < F.col("b_key")
    pick = lambda c: (F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")), F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")))
    src, dst = pick("key")
    return met.select(src.alias("src"), dst.alias("dst"), hamming(F.col("one"), F.col("two")).alias("distance"), *[x.alias(f"{n}_{c}") for c in carry for n, x in zip(("src", "dst"), pick(c), strict=True)])


def alike_aspect(a: F.Column, b: F.Column) -> F.Column:
    """Whether two aspect ratios are within five percent."""
    return F.greatest(a, b) / F.least(a, b) <= MAX_ASPECT


def mean_error(a: F.Column, b: F.Column) -> F.Column:
    """Mean absolute difference of two equally long numeric arrays, in doubles."""
    total = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def _thumb_error(a: pd.Series, b: pd.Series) -> pd.Series:
    scale = lambda x: np.frombuffer(b"".join(x), dtype=np.uint8).reshape(len(x), -1).astype(np.float32) / np.float32(255.0)
    return pd.Series(np.abs(np.subtract(scale(a), scale(b), dtype=np.float64)).mean(axis=1) if len(a) else np.empty(0))


def thumb_error(a: str, b: str) -> F.Column:
    """Mean absolute difference of two binary thumbnails scaled to [0, 1]."""
    return F.pandas_udf(_thumb_error, T.DoubleType())(a, b)


#: Bytes of a thumbnail (fixed value).
THUMB_BYTES = 64 * 64 * 3


def require_features(features: DataFrame) -> None:
    """Raise unless every row has a path of its own, a hash, a finite positive aspect
    ratio, a whole thumbnail and a usable vector (where it has that column)."""
    ratio = F.col("aspect_ratio")
    rules = {
        "hash": F.col("dhash").isNotNull(),
        "aspect ratio": ~F.isnan(ratio) & (ratio > 0) & (ratio < F.lit(float("inf"))),
        "thumbnail": F.octet_length("thumb") == THUMB_BYTES,
    } | ({"vector": is_usable(F.col("v"))} if "v" in features.columns else {})
    wrong = F.concat_ws(", ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    first = features.select("rel_path", wrong.alias("wrong")).where("wrong <> '' or rel_path is null").limit(1).collect()
    if first:
        raise GroupingError(f"{first[0].rel_path} has no usable {first[0].wrong or 'path'}")
    twice = features.groupBy("rel_path").count().where("count > 1").limit(1).collect()
    if twice:
        raise GroupingError(f"{twice[0].rel_path} stands in several rows")


def duplicate_edges(features: DataFrame) -> DataFrame:
    """(src, dst): pairs alike in hash, aspect ratio and thumbnail, src < dst.

    The cheap predicates run inside the banded join, which carries no pixels; the
    thumbnails of its survivors are looked up by key.
    """
    pairs = hamming_pairs(features, "rel_path", "dhash", ("aspect_ratio",))
    pairs = pairs.where(alike_aspect(F.col("src_aspect_ratio"), F.col("dst_aspect_ratio"))).select("src", "dst")
    thumb = lambda name: features.select(F.col("rel_path").alias(name), F.col("thumb").alias(f"{name}_thumb"))
    pairs = pairs.join(thumb("src"), "src").join(thumb("dst"), "dst")
    return pairs.where(thumb_error("src_thumb", "dst_thumb") <= MAX_THUMB_ERROR).select("src", "dst")


#: Rows of a product held at a time.
STRIP = 1024


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    sizes = np.diff(whole.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise GroupingError("vectors differ in length")
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def cosine_edges(vectors: DataFrame, threshold: float, block: int = 8192) -> DataFrame:
    """(src, dst, distance) of all pairs src < dst with cosine distance under the
    threshold; ``vectors`` has key (string) and v (unit array). Vectors that are null,
    zero or not finite are near to none.

    Rows are dealt into blocks, and a pair of blocks meets in one task as matrix
    products of strips; a task holds two blocks, one strip's distances and the pairs
    found, whatever the input's size.
    """
    blocks = max(1, -(-vectors.count() // block))
    usable = vectors.select("key", F.col("v").cast("array<double>").alias("v")).where(is_usable(F.col("v")))
    own = usable.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("key", "v", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def meet(group: pa.Table) -> pa.Table:
        keys, home = np.array(group.column("key").to_pylist(), dtype=object), group.column("own").to_numpy()
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        v = matrix(group.column("v"))
        left, right = np.flatnonzero(home == p), np.flatnonzero(home == q)
        names, others = keys[left], keys[right]
        found = [(np.empty(0, dtype=object), np.empty(0, dtype=object), np.empty(0))]
        turned = v[right].T
        for start in range(0, len(left), STRIP):
            far = np.clip(1.0 - v[left[start : start + STRIP]] @ turned, 0.0, 2.0)
            a, b = np.nonzero(far < threshold)
            src, dst, d = names[start + a], others[b], far[a, b]
            if p == q:
                keep = (src < dst).astype(bool)
                src, dst, d = src[keep], dst[keep], d[keep]
            swap = (src > dst).astype(bool)
            found.append((np.where(swap, dst, src), np.where(swap, src, dst), d))
        src, dst, d = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"src": pa.array(src, pa.string()), "dst": pa.array(dst, pa.string()), "distance": pa.array(d, pa.float64())})

    return cells.groupBy("p", "q").applyInArrow(meet, "src string, dst string, distance double")
