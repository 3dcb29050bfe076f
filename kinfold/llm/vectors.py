"""What the vector operators share: valid vectors, k-means on a bounded sample."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.arrow import bounded_batches, map_batches


def as_array(values: list | None) -> np.ndarray | None:
    """A vector as doubles; None if it is null, empty, zero or not finite."""
    if not values or any(x is None for x in values):
        return None
    v = np.array(values, dtype=np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def packed(df: DataFrame, id_col: str, vec_col: str, label: F.Column | None = None) -> DataFrame:
    """(vec_id, label, digest, vec): valid vectors as binary doubles with a
    128-bit digest; digest and vec are null for vectors that take no part."""
    rows = bounded_batches(df).select(F.col(id_col).alias("vec_id"), (F.lit(0) if label is None else label).cast("string").alias("label"), F.col(vec_col).alias("v"))

    def pack(batch):
        found = [as_array(v) for v in batch.column("v").to_pylist()]
        data = [None if v is None else (v + 0.0).astype("<f8").tobytes() for v in found]
        digest = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
        return {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "digest": digest, "vec": data}

    return map_batches(rows, pack, "vec_id long, label string, digest binary, vec binary")


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long binary vectors as rows of doubles."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype="<f8").reshape(len(data), -1)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def kmeans(rows: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """At most ``k`` centres by Lloyd's method."""
    centres = np.unique(rows[random.permutation(len(rows))[: min(k, len(rows))]], axis=0)
    for _ in range(rounds):
        own = np.concatenate([squared(rows[a : a + 4096], centres).argmin(1) for a in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres
