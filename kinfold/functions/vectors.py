"""Vector arithmetic as native column expressions (array<float> in, codegen out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.options import GroupingOptions


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not once for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _over_norm(v: Column, kind: str) -> Column:
    return let(F.struct(_doubles(v).alias("v"), l2_norm(v).alias("n")), lambda s: F.transform(s["v"], lambda x: F.try_divide(x, s["n"]).cast(kind)))


def l2_norm(v: Column) -> Column:
    """Euclidean length in doubles."""
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def is_usable(v: Column) -> Column:
    """Whether a vector is nonempty and finite with a finite nonzero length."""
    return let(F.struct(v.alias("v"), l2_norm(v).alias("n")), lambda s: _usable(s["v"], s["n"]))


def _usable(v: Column, norm: Column) -> Column:
    finite = F.forall(_doubles(v), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & (norm > 0) & (norm < F.lit(float("inf"))), F.lit(False))


def normalized(v: Column) -> Column:
    """The vector over its length, computed in doubles and stored as floats."""
    return _over_norm(v, "float")


def unit(v: Column) -> Column:
    """The vector over its length in doubles."""
    return _over_norm(v, "double")


def fused(content: Column, colour: Column, alpha: float = 0.80) -> Column:
    """Content and colour, each of length 1, weighted by root alpha and joined."""
    GroupingOptions(alpha=alpha)
    weigh = lambda v, w: F.transform(normalized(v), lambda x: (x * F.lit(w).cast("float")).cast("float"))
    return let(F.concat(weigh(content, math.sqrt(alpha)), weigh(colour, math.sqrt(1.0 - alpha))), normalized)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - inner product of unit vectors, clipped to [0, 2]."""
    return F.least(F.greatest(1.0 - dot(a, b), F.lit(0.0)), F.lit(2.0))
