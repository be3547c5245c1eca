"""Datasets: a DataFrame and, where the order of its rows can be seen, the hidden columns that hold it."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .functions import opaque
from .functions.order import HIDDEN, Order, columns_of, fresh, numbered, quoted, visible
from .operators import joins, keyed, layout
from .sources import files

if TYPE_CHECKING:
    from .session import Session

#: Storage of cached datasets by name.
STORAGE = {"disk": StorageLevel.DISK_ONLY, "memory": StorageLevel.MEMORY_ONLY, "memory_and_disk": StorageLevel.MEMORY_AND_DISK}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Dataset:
    """Rows, lazily computed. Methods that return a dataset leave this one as it is.

    Column expressions are planned by Spark; methods whose names end in _with take Python functions over rows (dicts by
    column), which run over Arrow batches, and the schema of what they return. The first column is the key of keyed methods.
    """

    def __init__(self, session: "Session", df: DataFrame, order: tuple[Order, ...] = (), lies: bool = True, release: bool = False):
        """lies: whether the rows lie in their order, partition after partition."""
        self.session, self._df, self.order, self._lies, self._release = session, df, order, lies, release

    @property
    def df(self) -> DataFrame:
        """The rows as a DataFrame, without the hidden columns."""
        return self._df.select(*[quoted(c) for c in self.columns])

    @property
    def columns(self) -> list[str]:
        return visible(self._df)

    @property
    def key(self) -> str:
        return self.columns[0]

    def _next(self, df: DataFrame, order: tuple[Order, ...] = (), lies: bool = True) -> "Dataset":
        return Dataset(self.session, df, order, lies)

    def _ordered(self) -> tuple[DataFrame, tuple[Order, ...]]:
        """The rows with an order: their own, or the one they lie in."""
        return (self._df, self.order) if self.order else numbered(self._df)

    def _in_order(self) -> DataFrame:
        """The rows, lying in their order if they have one; without the hidden columns."""
        df = self._df if self._lies or not self.order else self._df.orderBy(*columns_of(self.order))
        return df.select(*[quoted(c) for c in self.columns])

    def _done(self, result):
        if self._release:
            self.unpersist()
        return result

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    # rows to rows

    def map(self, *columns: Column | str, **named: Column) -> "Dataset":
        """Each row as the given expressions."""
        out = [_column(c) for c in columns] + [c.alias(n) for n, c in named.items()]
        return self._next(self._df.select(*out, *[o.name for o in self.order]), self.order, self._lies)

    def flat_map(self, items: Column | str, name: str = "value") -> "Dataset":
        """A row for each item of an array, in order; an empty or null array gives none."""
        if not self.order:
            return self._next(self._df.select(F.explode(_column(items)).alias(name)))
        place = fresh(self._df, "ord")
        out = self._df.select(*[o.name for o in self.order], F.posexplode(_column(items)).alias(place, name))
        return self._next(out, (*self.order, Order(place)), self._lies)

    def filter(self, condition: Column | str) -> "Dataset":
        """The rows for which condition, a boolean, is true."""
        return self._next(self._df.where(condition), self.order, self._lies)

    def map_with(self, f: Callable[[dict], object], schema: str | StructType) -> "Dataset":
        """f(row), for each row, as a row of schema. Its errors fail every action, count() too."""
        return self._next(opaque.over_rows(self._in_order(), lambda rows: map(f, rows), schema))

    def flat_map_with(self, f: Callable[[dict], Iterable], schema: str | StructType) -> "Dataset":
        return self._next(opaque.over_rows(self._in_order(), lambda rows: (x for r in rows for x in f(r)), schema))

    def filter_with(self, f: Callable[[dict], object]) -> "Dataset":
        """The rows for which f is true in Python's sense."""
        return self._next(opaque.over_rows(self._in_order(), lambda rows: (r for r in rows if f(r)), self.df.schema))

    def map_partitions_with(self, f: Callable[[list[dict]], Iterable], schema: str | StructType) -> "Dataset":
        """f(rows of a partition), also for empty ones. A task holds its partition, as functions.rows says; stream_partitions_with() doesn't."""
        return self._next(opaque.over_partitions(self._in_order(), f, schema))

    def stream_partitions_with(self, f: Callable[[Iterator[dict]], Iterable], schema: str | StructType) -> "Dataset":
        return self._next(opaque.over_rows(self._in_order(), f, schema))

    def glom(self, name: str = "rows") -> "Dataset":
        """An array for each partition, of its values or of structs if there are several columns; empty partitions too. A task holds its partition, as Arrow values."""
        schema, one = self.df.schema, len(self.columns) == 1
        kind = schema[0].dataType.simpleString() if one else schema.simpleString()
        return self._next(opaque.gathered(self._in_order(), f"`{name}` array<{kind}>", values=one))

    # sets

    def union(self, *others: "Dataset") -> "Dataset":
        """All rows of all, one dataset after the other; columns are matched by name. Repeated rows stay."""
        sides = [self, *others]
        if not any(d.order for d in sides):
            return self._next(reduce(DataFrame.unionByName, [d.df for d in sides]))
        side, order, out = f"{HIDDEN}side", [Order(f"{HIDDEN}side")], None
        for i, d in enumerate(sides):
            # each has order columns of its own, null for the rows of the others
            df, own = d._ordered()
            names = [f"{HIDDEN}side{i}_{k}" for k in range(len(own))]
            order += [Order(n, o.ascending) for n, o in zip(names, own)]
            one = df.select(*[quoted(c) for c in d.columns], F.lit(i).alias(side), *[F.col(o.name).alias(n) for n, o in zip(names, own)])
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if any(set(d.columns) != set(self.columns) for d in others):
            raise ValueError("the datasets of a union have the same columns")
        return self._next(out, tuple(order), lies=False)

    def distinct(self, partitions: int | None = None) -> "Dataset":
        """Each different row once; nulls are equal to each other."""
        out = self.df.distinct()
        return self._next(out.repartition(partitions, *[quoted(c) for c in self.columns]) if partitions else out)

    # by key

    # partitions is how many partitions the result has, by the key's hash; with partition_of, an expression of the key, key by key
    # into that partition. Native results are dealt so once they are combined: a row for each key moves, not each of its values.

    def _keyed(self, df: DataFrame, partitions: int | None, partition_of: Column | str | None) -> "Dataset":
        return self._next(layout.placed(df, partitions, self.key, partition_of))

    def combine_by_key(self, partitions: int | None = None, partition_of: Column | str | None = None, **aggregates: Column) -> "Dataset":
        """The key and aggregates of each of its groups: combined map-side, then after one shuffle."""
        return self._keyed(keyed.combine(self.df, [self.key], aggregates), partitions, partition_of)

    def combine_by_key_with(
        self, create: Callable, merge_value: Callable, merge_combiners: Callable, schema: str | StructType, finish: Callable | None = None, partitions: int | None = None, partition_of: Column | str | None = None
    ) -> "Dataset":
        """The key and what finish makes of its combiner, by schema; see operators.keyed.combine_opaque."""
        out = keyed.combine_opaque(self.df, self.key, create, merge_value, merge_combiners, schema, finish, None if partition_of is not None else partitions)
        return self._next(out) if partition_of is None else self._keyed(out, partitions, partition_of)

    def reduce_by_key(self, how: str = "sum", partitions: int | None = None, partition_of: Column | str | None = None) -> "Dataset":
        """The key and sum, min, max, count or product of each other column in its group. A product has its column's own type, exact; one that is out of its range is an error."""
        if how == "product":
            times = lambda a, b: b if a is None else a if b is None else a * b
            each = lambda a, b: {c: times(a[c], b[c]) for c in a} if isinstance(a, dict) else times(a, b)
            return self.reduce_by_key_with(each, partitions, partition_of)
        f = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
        return self._keyed(keyed.combine(self.df, [self.key], {c: f(quoted(c)) for c in self.columns[1:]}), partitions, partition_of)

    def reduce_by_key_with(self, f: Callable, partitions: int | None = None, partition_of: Column | str | None = None) -> "Dataset":
        """The key and the fold of its values by f, an associative function; the result has the values' own type."""
        rest = self.columns[1:]
        schema = StructType([self.df.schema[c] for c in rest])
        return self.combine_by_key_with(lambda v: v, f, f, schema, partitions=partitions, partition_of=partition_of)

    def group_with(self, *others: "Dataset", names: list[str] | None = None, partitions: int | None = None, partition_of: Column | str | None = None) -> "Dataset":
        """The key and, for each dataset, the list of its values for it ([] where there are none), in order."""
        sides = [self, *others]
        names = names or [f"v{i}" for i in range(len(sides))]
        ready = []
        for d in sides:
            df, order = d._ordered()
            if any(not o.ascending for o in order):
                df, order = numbered(d._df.orderBy(*columns_of(order)))
            key = quoted(d.key).alias(self.key)
            rest = [quoted(c) for c in d.columns[1:]] or [F.lit(True).alias("present")]
            ready.append((df.select(key, *rest, *[o.name for o in order]), order))
        return self._keyed(joins.cogroup(ready, self.key, names), partitions, partition_of)

    def cogroup(self, other: "Dataset", names: list[str] | None = None, partitions: int | None = None, partition_of: Column | str | None = None) -> "Dataset":
        return self.group_with(other, names=names, partitions=partitions, partition_of=partition_of)

    def _join(self, other: "Dataset", how: str, partitions: int | None, partition_of: Column | str | None) -> "Dataset":
        right = other.df if other.key == self.key else other.df.withColumnRenamed(other.key, self.key)
        return self._keyed(joins.join(self.df, right, self.key, how), partitions, partition_of)

    def join(self, other: "Dataset", partitions: int | None = None, partition_of: Column | str | None = None) -> "Dataset":
        """Rows whose keys are equal, nulls included, as key, own values, other's values."""
        return self._join(other, "inner", partitions, partition_of)

    def left_outer_join(self, other: "Dataset", partitions: int | None = None, partition_of: Column | str | None = None) -> "Dataset":
        return self._join(other, "left", partitions, partition_of)

    def right_outer_join(self, other: "Dataset", partitions: int | None = None, partition_of: Column | str | None = None) -> "Dataset":
        return self._join(other, "right", partitions, partition_of)

    def full_outer_join(self, other: "Dataset", partitions: int | None = None, partition_of: Column | str | None = None) -> "Dataset":
        return self._join(other, "full", partitions, partition_of)

    # order

    def sort_by(self, *keys: Column | str, ascending: bool = True, partitions: int | None = None) -> "Dataset":
        """Rows in the order of keys; ties keep the order that they had, in both directions.

        The order of the ties is part of what rows are dealt by, so a key that many rows share is spread over partitions.
        """
        df, before = self._ordered()
        names = []
        for k in keys:
            name = fresh(df, "key")
            df, names = df.withColumn(name, _column(k)), [*names, name]
        order = (*[Order(n, ascending) for n in names], *before)
        if partitions:
            df = df.repartitionByRange(partitions, *columns_of(order)).sortWithinPartitions(*columns_of(order))
        else:
            df = df.orderBy(*columns_of(order))
        return self._next(df, order)

    def sort(self, ascending: bool = True, partitions: int | None = None) -> "Dataset":
        """Rows in the order of their columns."""
        return self.sort_by(*[quoted(c) for c in self.columns], ascending=ascending, partitions=partitions)

    def with_places(self, name: str = "place") -> "Dataset":
        """Each row and its place in the order, from 0, found on the executors. The rows are kept as persist() keeps them."""
        place = fresh(self._df, "ord")
        out = layout.with_places(self._in_order(), name, STORAGE[self.session.default_storage])
        return self._next(out.withColumn(place, F.col(name)), (Order(place),), lies=False)

    # layout

    def partition_by(self, n: int, target: Column | str) -> "Dataset":
        """Row by row into partition target of n; within one the order stays. Any other target is an error."""
        df, order = self._ordered()
        name = fresh(df, "part")
        df = df.withColumn(name, _column(target).cast("int"))
        return self._next(layout.partition_by(df, n, F.col(name), order), (Order(name), *order))

    def repartition(self, n: int) -> "Dataset":
        """Rows dealt evenly to n partitions, in no order."""
        return self._next(self.df.repartition(n))

    def rebalance(self, n: int) -> "Dataset":
        """n partitions, more or fewer, of the same rows in the same order. The rows are computed twice unless they are cached."""
        df = self._in_order()
        return self._next(layout.rebalance(df, n, df.rdd.getNumPartitions()))

    @property
    def num_partitions(self) -> int:
        return self._df.rdd.getNumPartitions()

    # storage

    def persist(self, storage: str | None = None) -> "Dataset":
        """Keeps the rows once they are computed. This dataset itself, with that set."""
        self._df = self._df.persist(STORAGE[storage or self.session.default_storage])
        return self

    cache = persist

    def unpersist(self) -> "Dataset":
        """Drops what persist() keeps; nothing if it keeps nothing."""
        self._df.unpersist()
        return self

    def auto_unpersist(self) -> "Dataset":
        """A view of these rows whose first action ends by dropping what persist() keeps."""
        return Dataset(self.session, self._df, self.order, self._lies, release=True)

    # actions

    def collect(self) -> list[Row]:
        """All rows, in order. They must fit here."""
        return self._done(self._in_order().collect())

    def values(self) -> list:
        """collect(), for one column."""
        return [r[0] for r in self.collect()]

    def count(self) -> int:
        return self._done(self._df.count())

    def take(self, n: int) -> list[Row]:
        """The first n rows: a top-n in each partition, merged."""
        df, order = self._ordered()
        return self._done(df.orderBy(*columns_of(order)).limit(n).select(*[quoted(c) for c in self.columns]).collect())

    def _extreme(self, by: Column | str | None, greatest: bool):
        df, order = self._ordered()
        key = _column(by) if by is not None else quoted(self.columns[0])
        whole = F.struct(*[quoted(c) for c in self.columns])
        if any(not o.ascending for o in order):
            df, order = numbered(df.orderBy(*columns_of(order)))
        # of equal ones the last counts
        places, rows = [F.col(o.name) for o in order], df.where(key.isNotNull())
        if greatest:
            found = F.max_by(whole, F.struct(key, *places))
        elif all(isinstance(df.schema[o.name].dataType, IntegralType) for o in order):
            found = F.min_by(whole, F.struct(key, *[-p for p in places]))
        else:
            least = rows.agg(F.min(key).alias(f"{HIDDEN}least"))
            rows = rows.join(F.broadcast(least), key.eqNullSafe(F.col(f"{HIDDEN}least")))  # one row
            found = F.max_by(whole, F.struct(*places))
        return self._done(rows.agg(found.alias("x")).first()["x"])

    def max(self, by: Column | str | None = None) -> Row | None:
        """The row with the greatest key (by default the first column), the last of equal ones; None without rows. NaN is greatest, nulls don't count."""
        return self._extreme(by, True)

    def min(self, by: Column | str | None = None) -> Row | None:
        """The row with the least key, the last of equal ones; None without rows."""
        return self._extreme(by, False)

    def max_with(self, compare: Callable) -> dict | None:
        """The greatest row by a comparator of rows, the later of equal ones."""
        return self.reduce_with(lambda a, b: a if compare(a, b) > 0 else b)

    def min_with(self, compare: Callable) -> dict | None:
        return self.reduce_with(lambda a, b: a if compare(a, b) < 0 else b)

    def reduce(self, aggregate: Column):
        """An aggregate over all rows, such as sum; None where it is null, as for sums without rows."""
        return self._done(self.df.agg(aggregate.alias("x")).first()["x"])

    def reduce_with(self, f: Callable):
        """The fold of all rows, in order, by f, an associative function: each partition's first, then theirs here. None without rows."""

        def fold(rows):
            total, started = None, False
            for r in rows:
                total, started = (f(total, r), True) if started else (r, True)
            return [total] if started else []

        parts = sorted(opaque.partials(self._in_order(), fold).collect(), key=lambda r: (r["part"], r["place"]))
        found = fold(pickle.loads(p["value"]) for p in parts)
        return self._done(found[0] if found else None)

    def save_as_text_file(self, uri: str, overwrite: bool = True, extension: str = "txt", compression: str | None = None, compressor: Callable[[bytes], bytes] | None = None, encoding: str = "utf8") -> None:
        """A line for each row; see sources.files.save_text."""
        files.save_text(self._in_order(), uri, overwrite, extension, compression, compressor, self.session.loaders.get(uri), encoding)
        self._done(None)
