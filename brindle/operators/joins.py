"""Cogroup and the equi-joins. Null keys match null keys. Spark picks the join: sort-merge, or broadcast below its own threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import Order, quoted


def join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """key, then the other columns of left, then those of right; what is missing on a side is null."""
    mine, theirs = [c for c in left.columns if c != key], [c for c in right.columns if c != key]
    if clash := set(mine) & set(theirs):
        raise ValueError(f"both sides have the columns {sorted(clash)}; rename one")
    if left.schema[key].dataType != right.schema[key].dataType:
        raise TypeError(f"the keys have the types {left.schema[key].dataType.simpleString()} and {right.schema[key].dataType.simpleString()}")
    # names of our own on both sides: theirs may be anything
    left = left.select(quoted(key).alias("a"), *[quoted(c).alias(f"a{i}") for i, c in enumerate(mine)])
    right = right.select(quoted(key).alias("b"), *[quoted(c).alias(f"b{i}") for i, c in enumerate(theirs)])
    a, b = F.col("a"), F.col("b")
    both = left.join(right, a.eqNullSafe(b), how)
    own = {"inner": a, "left": a, "right": b, "full": F.coalesce(a, b)}[how]
    return both.select(own.alias(key), *[F.col(f"a{i}").alias(c) for i, c in enumerate(mine)], *[F.col(f"b{i}").alias(c) for i, c in enumerate(theirs)])


def cogroup(sides: list[tuple[DataFrame, tuple[Order, ...]]], key: str, names: list[str]) -> DataFrame:
    """key and, for each side, the list of its values for the key, in the side's order; [] where it has none.

    All sides go through one shuffle. A side's value is its one other column, or a struct of them.
    """
    kind = sides[0][0].schema[key].dataType
    values, tagged = [], None
    for df, _ in sides:
        if df.schema[key].dataType != kind:
            raise TypeError(f"keys of the types {kind.simpleString()} and {df.schema[key].dataType.simpleString()}")
    for i, (df, order) in enumerate(sides):
        rest = [c for c in df.columns if c != key and c not in {o.name for o in order}]
        value = quoted(rest[0]) if len(rest) == 1 else F.struct(*[quoted(c) for c in rest])
        descending = [o for o in order if not o.ascending]
        if descending:
            raise ValueError("a side sorted downwards has no ascending place; number it first")
        place = F.struct(*[F.col(o.name) for o in order], F.lit(0).alias("_"))
        values.append(df.select(quoted(key).alias("k"), F.struct(place.alias("place"), value.alias("value")).alias(f"s{i}")))
    for v in values:
        tagged = v if tagged is None else tagged.unionByName(v, allowMissingColumns=True)
    lists = [F.transform(F.array_sort(F.collect_list(f"s{i}")), lambda x: x["value"]).alias(name) for i, name in enumerate(names)]
    return tagged.groupBy("k").agg(*lists).withColumnRenamed("k", key)
