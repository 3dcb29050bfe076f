"""Listing a folder on the driver, and routing what is not an image.

Spark's file sources hide names that begin with a dot or underscore, so the
listing is a driver-side walk and becomes a DataFrame.
"""

from __future__ import annotations

import os
from pathlib import Path, PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.paths import is_supported, skip_reason
from kinfold.options import UsageError

SCHEMA = "rel_path string, abs_path string, ext string"


def walk(source: Path, recursive: bool) -> list[tuple[str, str, str]]:
    """(rel_path, abs_path, ext) of the files in path order; linked folders are
    not followed, an unreadable folder raises."""
    source = source.resolve(strict=True)
    if not source.is_dir():
        raise NotADirectoryError(f"Source is not a directory: {source}")
    found = []
    todo = [source]
    while todo:
        with os.scandir(todo.pop()) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=not recursive):
                    if recursive and not e.is_junction():
                        todo.append(Path(e.path))
                elif not (recursive and e.is_symlink() and e.is_dir()):
                    found.append(Path(e.path))
    rows = [(p.relative_to(source).as_posix(), str(p), PurePath(p).suffix) for p in found]
    return sorted(rows)


def discover(spark: SparkSession, source: Path, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Image files (rel_path, abs_path, ext) and skipped rows (rel_path, reason)."""
    try:
        rows = walk(Path(source), recursive)
    except OSError as error:
        raise UsageError(f"Cannot read source: {error}") from error
    files = spark.createDataFrame(rows, SCHEMA)
    known = is_supported(F.col("ext"))
    return files.where(known), files.where(~known).select("rel_path", skip_reason(F.col("ext")).alias("reason"))
