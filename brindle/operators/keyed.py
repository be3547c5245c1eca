"""Aggregation by key. Native aggregates combine map-side in Spark; opaque combiners do the same here, over Arrow batches.

A null key is a key like any other. Keys are atomic values, arrays or structs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.opaque import _batches, rows_of, schema_of
from ..functions.order import quoted

#: Combiners that a task holds before it sends them on; they meet again at the reducer.
MOST_HELD = 50_000


def combine(df: DataFrame, key: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """One row for each key: partial aggregation, one shuffle, final aggregation."""
    return df.groupBy(*[quoted(k) for k in key]).agg(*[c.alias(name) for name, c in aggregates.items()])


def _frozen(x):
    """x as a dict's key."""
    if isinstance(x, list):
        return ("list", *map(_frozen, x))
    if isinstance(x, dict):
        return ("dict", *[(k, _frozen(v)) for k, v in x.items()])
    return "nan" if isinstance(x, float) and x != x else x


def combine_opaque(df: DataFrame, key: str, create: Callable, merge_value: Callable, merge_combiners: Callable, schema: str | StructType, finish: Callable | None = None, partitions: int | None = None) -> DataFrame:
    """key and, by schema, what finish makes of each key's combiner (itself by default).

    A row's value is the dict of its other columns, or the value alone if there is one. Each task combines its own
    rows first, at most MOST_HELD keys at a time; combiners of a key are merged in the order of their tasks, streamed in
    order of the key, so a task holds one key's combiner at a time.
    """
    values = [c for c in df.columns if c != key]
    key_field, out = df.schema[key], schema_of(df, schema)
    arrow_key = to_arrow_schema(StructType([key_field])).field(0).type

    def held(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        found: dict = {}

        def told():
            nonlocal place
            keys, combiners = [k for k, _ in found.values()], [pickle.dumps(c) for _, c in found.values()]
            n = len(keys)
            batch = pa.RecordBatch.from_arrays([pa.array(keys, arrow_key), pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(combiners, pa.binary())], names=["key", "part", "place", "combiner"])
            place += n
            found.clear()
            return batch

        for row in rows_of(batches):
            value = row[values[0]] if len(values) == 1 else {c: row[c] for c in values}
            k = _frozen(row[key])
            old = found.get(k)
            found[k] = (row[key], create(value) if old is None else merge_value(old[1], value))
            if len(found) >= MOST_HELD:
                yield told()
        if found:
            yield told()

    sent = StructType([StructField("key", key_field.dataType, True), *StructType.fromDDL("part int, place long, combiner binary").fields])
    parts = df.mapInArrow(held, sent)
    parts = (parts.repartition(partitions, "key") if partitions else parts.repartition("key")).sortWithinPartitions("key", "part", "place")
    merged = StructType([StructField(key, key_field.dataType, True), *out.fields])

    def merge(batches):
        def run():
            current, combiner, started = None, None, False
            for row in rows_of(batches):
                k, c = _frozen(row["key"]), pickle.loads(row["combiner"])
                if started and k == current[0]:
                    combiner = merge_combiners(combiner, c)
                    continue
                if started:
                    yield result(current[1], combiner)
                current, combiner, started = (k, row["key"]), c, True
            if started:
                yield result(current[1], combiner)

        def result(k, c):
            x = finish(c) if finish else c
            if isinstance(x, dict):
                return {key: k} | x
            return dict(zip(merged.names, (k, *x) if isinstance(x, tuple) and len(out) > 1 else (k, x)))

        yield from _batches(run(), merged)

    return parts.mapInArrow(merge, merged)


