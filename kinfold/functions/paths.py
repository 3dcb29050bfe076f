"""Relative paths: suffixes, separators, and what makes a path unacceptable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.options import EXTENSIONS


def suffix(path: Column) -> Column:
    """The last component's suffix with its dot, as pathlib has it: empty without
    a dot, and where the only dot begins or ends the name."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?s)^.+(\.[^.]+)$", 1)


def is_supported(ext: Column) -> Column:
    """Whether a suffix names an image format, in either case."""
    return F.lower(ext).isin(*EXTENSIONS)


def skip_reason(ext: Column) -> Column:
    """Why an unsupported file is left out."""
    return F.concat(F.lit("unsupported extension: "), F.when(ext == "", F.lit("(none)")).otherwise(ext))


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/", -1), lambda p: ~p.isin("", "."))


def normalized_path(path: Column) -> Column:
    """The path with forward slashes, without empty or single-dot components."""
    return F.array_join(_parts(path), "/")


def is_relative(path: Column) -> Column:
    """Whether a path is nonempty and has no drive, root or parent component."""
    flat = F.translate(path, "\\", "/")
    return ~flat.rlike(r"^.:|^/") & (F.size(_parts(path)) > 0) & ~F.array_contains(_parts(path), "..")
