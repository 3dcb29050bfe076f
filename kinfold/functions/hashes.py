"""Difference hashes and their blocks as native column expressions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of six blocks of a 64-bit hash, and the choices of two of them: hashes that
#: differ in at most four bits agree in two blocks.
EDGES = tuple(64 * k // 6 for k in range(7))
BLOCK_PAIRS = tuple(combinations(range(6), 2))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit patterns differ."""
    return F.bit_count(a.bitwiseXOR(b))


def block(h: Column, number: int) -> Column:
    """The bits of one block."""
    return F.shiftrightunsigned(h, EDGES[number]).bitwiseAND(F.lit((1 << EDGES[number + 1] - EDGES[number]) - 1))


def block_pair(h: Column, a: int, b: int) -> Column:
    """The bits of two blocks in one number."""
    return F.shiftleft(block(h, a), EDGES[b + 1] - EDGES[b]).bitwiseOR(block(h, b))


def first_agreement(a: Column, b: Column) -> Column:
    """The number of the first of BLOCK_PAIRS in which two hashes agree."""
    differ = a.bitwiseXOR(b)
    found = F.lit(None).cast("int")
    for number, (x, y) in reversed(list(enumerate(BLOCK_PAIRS))):
        mask = sum((1 << EDGES[k + 1]) - (1 << EDGES[k]) for k in (x, y))
        found = F.when(differ.bitwiseAND(F.lit(mask - (mask >> 63 << 64))) == 0, F.lit(number)).otherwise(found)
    return found


def grid_dhash(cells: Column, columns: int = 9, rows: int = 8) -> Column:
    """The difference hash of a row-major grid: a bit is 1 where a cell exceeds
    its right neighbour, the first cell is the highest bit."""
    pairs = F.array(*[F.lit(r * columns + c) for r in range(rows) for c in range(columns - 1)])
    step = lambda s, i: F.shiftleft(s, 1).bitwiseOR(F.when(F.get(cells, i) > F.get(cells, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(pairs, F.lit(0).cast("long"), step)
