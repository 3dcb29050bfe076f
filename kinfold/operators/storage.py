"""Cutting lineage through the folder that the cluster shares.

Intermediate results that are read more than once are written as Parquet below
``spark.checkpoint.dir``. Every executor can reread them, so losing one costs
nothing but the tasks it ran. A scope deletes what its result does not read; what
is left at the end of the application goes with its folder.
"""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Used only by a master within one machine, where the session names no folder.
LOCAL_DIR = "file:///tmp/checkpoints"
#: Folders written in each open scope, the innermost last.
_scopes: list[list[str]] = []
_cleared: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Without one, only a local master may go on."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(LOCAL_DIR)
        found = LOCAL_DIR
    return found.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear(spark: SparkSession, folder: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, folder)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """The rows of ``df``, stored as a table in the shared folder and read back."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}"
    if own not in _cleared:
        _cleared.add(own)
        atexit.register(_clear, spark, own)
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # unlike the default, without buffers outside the heap
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_path(df: DataFrame) -> list[str]:
    """The folders made by ``written`` that a table reads."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles() if "/kinfold/" in f})


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    for folder in stored_path(df):
        _delete(df.sparkSession, folder)


class Scope:
    """What a scope returns and so keeps."""

    def __init__(self) -> None:
        self.names: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Keep all tables that ``df`` reads."""
        self.names |= {f.rsplit("/", 1)[-1] for f in stored_path(df)}
        return df


@contextmanager
def scratch(spark: SparkSession):
    """A scope: tables written in it are deleted at its end but for the kept ones,
    which are the surrounding scope's then."""
    own: list[str] = []
    _scopes.append(own)
    scope = Scope()
    try:
        yield scope
    finally:
        _scopes.remove(own)
        for path in own:
            if path.rsplit("/", 1)[-1] not in scope.names:
                _delete(spark, path)
            elif _scopes:
                _scopes[-1].append(path)


def scoped(function):
    """Runs a function of a table in a scope of its own that keeps what it returns."""

    @wraps(function)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        with scratch(df.sparkSession) as own:
            return own.keep(function(df, *args, **options))

    return run
