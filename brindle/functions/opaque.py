"""Python functions over rows. They run over Arrow batches; the types of what they return are declared.

Functions are carried with what they capture, by value: a worker changes its own copy. Rows are dicts by column name.
They never run as column functions, which Spark leaves out where their result isn't needed, errors and all.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .rows import Rows

#: Rows in a batch that a function's results are sent back in.
_ROWS = 4096


def schema_of(df: DataFrame, schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _batch(rows: list, schema: StructType, arrow: pa.Schema) -> pa.RecordBatch:
    names = schema.names
    told = []
    for r in rows:
        if isinstance(r, dict):
            told.append(r)
        elif isinstance(r, (tuple, list)) and len(r) == len(names) and len(names) > 1:
            told.append(dict(zip(names, r)))
        elif len(names) == 1:
            told.append({names[0]: r[0] if isinstance(r, tuple) and len(r) == 1 else r})
        else:
            raise TypeError(f"a row of {len(names)} columns was expected, not {r!r}")
    return pa.RecordBatch.from_pylist(told, schema=arrow)


def _batches(rows: Iterable, schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == _ROWS:
            yield _batch(held, schema, arrow)
            held = []
    if held:
        yield _batch(held, schema, arrow)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def over_rows(df: DataFrame, f: Callable[[Iterator[dict]], Iterable], schema: str | StructType) -> DataFrame:
    """f over the rows of each partition as a stream, its results as rows of schema."""
    schema = schema_of(df, schema)

    def run(batches):
        yield from _batches(f(rows_of(batches)), schema)

    return df.mapInArrow(run, schema)


def over_partitions(df: DataFrame, f: Callable[[list[dict]], Iterable], schema: str | StructType) -> DataFrame:
    """f over each whole partition as a list, empty ones included; see functions.rows."""
    schema = schema_of(df, schema)

    def run(batches):
        yield from _batches(f(Rows(batches=batches)), schema)

    return df.mapInArrow(run, schema)


def gathered(df: DataFrame, schema: str | StructType, values: bool) -> DataFrame:
    """An array of each partition's rows, empty ones included: of the values of its one column, or of structs. The rows stay in Arrow's own form;
    while they are put together a task holds them twice."""
    schema = schema_of(df, schema)

    def run(batches):
        arrow = to_arrow_schema(schema)
        kind = arrow.field(0).type
        pieces = [b.column(0) if values else b.to_struct_array() for b in batches]
        pieces = [x if x.type == kind.value_type else x.cast(kind.value_type) for x in pieces]
        whole = pa.concat_arrays(pieces) if pieces else pa.array([], kind.value_type)
        pieces.clear()
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole, type=kind)], schema=arrow)

    return df.mapInArrow(run, schema)


def partials(df: DataFrame, f: Callable[[Iterator[dict]], Iterable]) -> DataFrame:
    """f over each partition, its results pickled in the column value, numbered by partition and place."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, x in enumerate(f(rows_of(batches))):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "place": pa.array([k], pa.int64()), "value": pa.array([pickle.dumps(x)], pa.binary())})

    return df.mapInArrow(run, "part int, place long, value binary")
