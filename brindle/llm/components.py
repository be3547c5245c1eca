"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, saved

#: Edges in a task, about: 16 bytes each.
EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for each node of edges (two long columns): root is the least node of its component.

    Alternates large-star and small-star steps until the edges no longer change; each round is checkpointed. Only a count
    and a checksum come to the driver. Loops and repeated edges are allowed; an edge with a null end is ignored; no edges, no rows.

    No step makes more edges than it is given, so their number tells how many partitions they need, whatever the cluster's number for
    shuffles is. What fits in one isn't shuffled: Spark knows that a single partition has the rows of each key together.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    e = saved(e.distinct())
    state = _state(e)
    few = lambda df: df.coalesce(max(1, ceil(state[0] / EDGES)))  # noqa: E731  never more partitions than df has
    kept = lambda df: few(saved(few(df)))  # noqa: E731  what is saved doesn't say that it is a single partition
    # joins would deal two single partitions again; so the smaller side, two rows for an edge at most, is broadcast to the other
    told = lambda df: F.broadcast(df) if state[0] <= EDGES else df
    e = few(e)
    while True:
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(apart(F.col("u")).alias("u"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(told(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = kept(large)
        # the least neighbour's own edge is the one that joins u to it
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(apart(F.col("u")).alias("u"), "m")
        small = large.join(told(least), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = kept(small.where(F.col("u") != F.col("v")).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
