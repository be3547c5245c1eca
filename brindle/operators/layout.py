"""Which partition a row lies in."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import Order, columns_of, fresh, quoted


def partition_by(df: DataFrame, n: int, target: Column, order: tuple[Order, ...] = ()) -> DataFrame:
    """Each row in partition target, from 0 to n - 1, in the order given within it; any other target, null included, is an error."""
    t = target.cast("int")
    checked = F.when(t.between(0, n - 1), t).otherwise(F.raise_error(F.concat(F.lit(f"not a partition from 0 to {n - 1}: "), F.coalesce(target.cast("string"), F.lit("null")))).cast("int"))
    out = df.repartitionById(n, checked)
    return out.sortWithinPartitions(*columns_of(order)) if order else out


def placed(df: DataFrame, n: int | None, key: str, target: Column | str | None) -> DataFrame:
    """df, whose rows stand for keys, in n partitions: by the key's hash, or each in partition target, an expression of the key. As it is without n."""
    if target is None:
        return df.repartition(n, quoted(key)) if n else df
    if not n:
        raise ValueError("a partition function needs the number of partitions")
    return partition_by(df, n, F.expr(target) if isinstance(target, str) else target)


def with_places(df: DataFrame, name: str, storage: StorageLevel) -> DataFrame:
    """df and each row's place, from 0, in the order in which the rows lie. The rows are kept in storage, so that both passes see one layout; the number of
    rows in each partition alone comes to the driver."""
    part, order = fresh(df, "part"), fresh(df, "ord")
    rows = df.withColumn(order, F.monotonically_increasing_id()).withColumn(part, F.shiftright(order, 33).cast("int")).persist(storage)
    before, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part).agg(F.count(F.lit(1))).collect()):
        before.append((p, total))
        total += n
    # a row for each partition: a table as small as the layout itself
    firsts = df.sparkSession.createDataFrame(before, f"{part} int, {order}_first long")
    place = F.col(f"{order}_first") + F.col(order).bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(firsts), part).withColumn(name, place).drop(part, order, f"{order}_first")


def _cuts(sizes: dict[int, int], n: int) -> list[tuple[int, int, list[int]]]:
    """For each source partition: itself, the cuts before it and the places of those within it, by which its rows fall to n targets."""
    o, out = max(sizes, default=-1) + 1, []
    for p in range(o):
        before = sum(1 for k in range(1, n) if k * o < p * n)
        own = [sizes.get(p, 0) * (k * o - p * n) // n for k in range(1, n) if p * n <= k * o < (p + 1) * n]
        out.append((p, before, own))
    return out


def rebalance(df: DataFrame, n: int, partitions: int) -> DataFrame:
    """The rows of df, in their order, in n partitions (more or fewer): contiguous cuts, in proportion within each source partition.

    One pass counts each partition's rows; these counts alone come to the driver. The layout must be the same in both passes.
    """
    part, place, order = fresh(df, "part"), fresh(df, "place"), fresh(df, "ord")
    rows = df.withColumn(order, F.monotonically_increasing_id())
    rows = rows.withColumn(part, F.shiftright(order, 33).cast("int")).withColumn(place, F.col(order).bitwiseAND((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in rows.groupBy(part).agg(F.count(F.lit(1))).collect()}
    sizes.setdefault(max(partitions - 1, 0), 0)
    # a row for each source partition: a table as small as the layout itself
    cuts = df.sparkSession.createDataFrame(_cuts(sizes, n), f"{part} int, before int, own array<bigint>")
    target = F.col("before") + F.size(F.filter("own", lambda x: x <= F.col(place)))
    rows = rows.join(F.broadcast(cuts), part).withColumn("target", target).drop("before", "own", part, place)
    return rows.repartitionById(n, F.col("target")).sortWithinPartitions(order).drop("target", order)
