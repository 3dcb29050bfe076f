"""Small helpers that the Arrow-batched operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a batch handed to Python, so that long texts cannot pile up.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: Rows that operators on many small groups gather before they begin.
GATHER = 1 << 16


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bound Arrow batches by rows and bytes for the session of ``df``."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and text alone, null texts as empty ones."""
    return bounded_batches(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[dict] | dict | None], schema: str | T.StructType) -> DataFrame:
    """Apply ``function`` to each Arrow batch; it gives columns by name."""
    names = [f.name for f in (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields]
    types = [pa_type(f.dataType) for f in (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields]
    target = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = function(batch)
                for columns in [found] if isinstance(found, dict) else found or ():
                    yield pa.RecordBatch.from_arrays([pa.array(columns[n], type=t) if not isinstance(columns[n], pa.Array) else columns[n].cast(t) for n, t in zip(names, types, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    """Arrow's type for the Spark types that the operators use."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to GATHER rows or more."""
    own, rows = [], 0
    for batch in batches:
        own.append(batch)
        rows += batch.num_rows
        if rows >= GATHER:
            yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            own, rows = [], 0
    if rows:
        yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of rows in the order of ``names``: batches that cut no group in two, each
    with the bounds of its groups (one more than there are groups)."""
    held = None
    for batch in gathered(batches):
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        edge = np.zeros(whole.num_rows - 1, dtype=bool)
        for name in names:
            column = whole.column(name).to_numpy()
            edge |= column[1:] != column[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(edge) + 1])
        held = whole.slice(int(bounds[-1]))  # the last group may go on in the next batch
        if len(bounds) > 1:
            yield whole.slice(0, int(bounds[-1])), bounds
    if held is not None:
        yield held, np.array([0, held.num_rows])
