"""Bit-sliced comparison of fingerprints.

Bit planes stand vertically, 64 fingerprints to a machine word. Plane after plane
the differing lanes are added into carry-save counters, and a block of lanes is
abandoned once every lane in it exceeds the radius.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.arrow import bounded_batches, map_batches

#: Lanes of a block of planes.
LANES = 4096
#: Buckets up to SMALL members are compared together, PAIR_LANES pairs at a time.
SMALL, PAIR_LANES = 24, 1 << 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


class Planes:
    """Fingerprints as vertical bit planes, compared 64 lanes to a word; several
    prints of a document (the columns of ``fps``) stand one below the other."""

    def __init__(self, fps: np.ndarray) -> None:
        self.n = len(fps)
        width, depth = -(-self.n // 64), 64 * (fps.shape[1] if fps.ndim > 1 else 1)
        bits = np.zeros((width * 64, depth), dtype=np.uint8)
        bits[: self.n] = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(-1, depth // 8), axis=1, bitorder="little")
        self.plane = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").reshape(depth, width)
        self.live = np.full(width, _ONES, dtype=np.uint64)
        if self.n % 64:
            self.live[-1] = np.uint64((1 << self.n % 64) - 1)

    def drop(self, lanes: np.ndarray) -> None:
        """Take lanes out of all further comparisons."""
        np.bitwise_and.at(self.live, lanes >> 6, ~(np.uint64(1) << (lanes & 63).astype(np.uint64)))

    def within(self, fp: int, radius: int, lanes: int = LANES) -> np.ndarray:
        """Live lanes that differ from ``fp`` in at most ``radius`` bits."""
        found = []
        step = lanes // 64
        for lo in range(0, len(self.live), step):
            near = self.live[lo : lo + step].copy()
            if near.any():
                self._count(self.plane[:, lo : lo + step], near, fp, radius)
                if near.any():
                    found.append(np.flatnonzero(np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")) + lo * 64)
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    @staticmethod
    def _count(plane: np.ndarray, near: np.ndarray, fp: int, radius: int) -> None:
        """Clear the lanes of ``near`` whose counters pass ``radius``."""
        levels = (radius + 1).bit_length()
        counter = np.zeros((levels, len(near)), dtype=np.uint64)
        for k in range(0, len(plane), 2):
            a = plane[k] ^ _ONES if fp >> k & 1 else plane[k]
            b = plane[k + 1] ^ _ONES if fp >> k + 1 & 1 else plane[k + 1]
            low = counter[0]  # a full adder takes two planes and the lowest counter at once
            mixed = a ^ b
            carry = (a & b) | (mixed & low)
            counter[0] = mixed ^ low
            for level in range(1, levels):
                now = counter[level]
                carry, counter[level] = now & carry, now ^ carry
            near &= ~carry  # over the top of the counters
            if k % 8 == 6:
                near &= ~_over(counter, radius)
                if not near.any():
                    return
        near &= ~_over(counter, radius)


def _over(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is greater than ``radius``."""
    over, same = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            same &= counter[level]
        else:
            over |= same & counter[level]
            same &= ~counter[level]
    return over


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) of a spanning forest of all pairs within the radius."""
    planes, parents, children = Planes(fps), [], []
    reached = np.zeros(len(fps), dtype=bool)
    for start in range(len(fps)):
        if reached[start]:
            continue
        reached[start] = True
        planes.drop(np.array([start]))
        queue = [start]
        while queue:
            at = queue.pop()
            found = planes.within(int(fps[at]), radius)
            if len(found):
                planes.drop(found)
                reached[found] = True
                parents.append(np.full(len(found), at))
                children.append(found)
                queue.extend(found.tolist())
    return (np.concatenate(parents), np.concatenate(children)) if parents else (np.empty(0, int), np.empty(0, int))


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of fingerprints are within the radius: a lane for each pair."""
    found = []
    for lo in range(0, len(a), PAIR_LANES):
        planes = Planes(a[lo : lo + PAIR_LANES] ^ b[lo : lo + PAIR_LANES])
        found.append(planes.within(0, radius, PAIR_LANES) + lo)
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) of many small buckets at once."""
    left, right = [], []
    for size in np.unique(sizes):
        own = starts[sizes == size]
        x, y = np.triu_indices(size, 1)
        step = max(1, (4 * PAIR_LANES) // len(x))
        for lo in range(0, len(own), step):
            a, b = ((own[lo : lo + step, None] + z[None, :]).ravel() for z in (x, y))
            at = near_pairs(fps[a], fps[b], radius)
            left.append(a[at])
            right.append(b[at])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def stacked(columns: list) -> np.ndarray:
    """Fingerprints of several columns side by side."""
    return np.stack([c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c for c in columns], axis=1).view(np.uint64)


def proposed(pairs: DataFrame, head: str, names: list[str], radius: int) -> DataFrame:
    """Distinct (src, dst), src < dst, of rows (rep and prints) and their ``head``
    (a struct of the same) whose prints differ in at most ``radius`` bits."""

    def near(batch):
        at = near_pairs(stacked([batch.column(n) for n in names]), stacked([batch.column(f"h_{n}") for n in names]), radius)
        a, b = batch.column("rep").to_numpy()[at], batch.column("h_rep").to_numpy()[at]
        return {"src": pa.array(np.minimum(a, b)), "dst": pa.array(np.maximum(a, b))}

    sides = pairs.select("rep", *names, *[F.col(f"{head}.{c}").alias(f"h_{c}") for c in ("rep", *names)])
    return map_batches(bounded_batches(sides), near, "src long, dst long").distinct()
