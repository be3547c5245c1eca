"""Sharding: a hierarchical weighted hash tree.

A row descends from the root through regions and racks to a shard. At each node every child draws -ln(u) / weight, u
uniform from a hash of the row's id and the child's name, and the least draw wins, so a child gets rows in proportion to
its weight. A node's weight is its own, not the sum of what hangs below it: a change inside a rack moves rows inside
that rack alone, and a new branch takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Draws come from the first 13 hex digits of an MD5: 52 bits, exact in a double.
_BITS = 52


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: a name that no sibling has, the weight of its draws and its children, or a shard's number."""

    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = field(default=())
    shard: int | None = None

    def shards(self) -> list[int]:
        return [self.shard] if self.shard is not None else [s for x in self.children for s in x.shards()]


def layout(shards: int, racks_a_region: int = 2, shards_a_rack: int = 5) -> Node:
    """A tree of equal regions; shards over the last whole region each hang from the root as a region of one.

    Its weights are the number of shards below each node, so sizes are near equal in rows. From a multiple of
    racks_a_region * shards_a_rack on, one more shard is a new branch.
    """
    if shards < 1:
        raise ValueError("a layout has at least one shard")
    each = racks_a_region * shards_a_rack
    whole = shards // each
    regions = [
        Node(
            f"region{r}",
            each,
            tuple(
                Node(f"rack{r}.{k}", shards_a_rack, tuple(Node(f"shard{s}", 1.0, shard=s) for s in range(r * each + k * shards_a_rack, r * each + (k + 1) * shards_a_rack)))
                for k in range(racks_a_region)
            ),
        )
        for r in range(whole)
    ]
    singles = [Node(f"branch{s}", 1.0, (Node(f"rack.{s}", 1.0, (Node(f"shard{s}", 1.0, shard=s),)),)) for s in range(whole * each, shards)]
    return Node("root", shards, tuple(regions + singles))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """tree with one more shard, in a branch of its own under the root: rows move into it alone."""
    s = max(tree.shards()) + 1
    branch = Node(f"branch{s}", weight, (Node(f"rack.{s}", weight, (Node(f"shard{s}", weight, shard=s),)),))
    return Node(tree.name, tree.weight + weight, (*tree.children, branch))


def _nodes(tree: Node) -> list[Node]:
    out, at = [tree], 0
    while at < len(out):
        out += out[at].children
        at += 1
    return out


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a row by its key alone (a null key as the text "null")."""
    nodes = _nodes(tree)
    number = {id(x): i for i, x in enumerate(nodes)}
    if len({x.name for x in nodes}) < len(nodes):
        raise ValueError("two nodes have one name")
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def drawn(x: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(x["name"], F.lit(":"), key).cast("binary")), 1, _BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _BITS)
        return F.struct((-F.ln(u) / x["weight"]).alias("draw"), x["node"].alias("node"))

    below, depth = [], 0
    for x in nodes:
        live = [c for c in x.children if c.weight > 0]
        if x.shard is None and not live:
            raise ValueError(f"{x.name} has no child with a weight over zero")
        live = live or [x]  # a shard stands for itself once it is reached
        below.append(F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(number[id(c)]).alias("node")) for c in live]))
    level = [tree]
    while level := [c for x in level for c in x.children]:
        depth += 1
    children, at = F.array(*below), F.lit(0)
    for _ in range(depth):
        at = F.array_min(F.transform(F.get(children, at), drawn))["node"]
    return F.get(F.array(*[F.lit(-1 if x.shard is None else x.shard) for x in nodes]), at)


def assign_shards(docs: DataFrame, tree: Node, more: Node | None = None, id_col: str = "doc_id", text_col: str = "text", cells: int = 256) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, shard, slot, grown_shard.

    doc_id and the tree decide the shard. size is the text's UTF-8 bytes plus 16; slot numbers a shard's rows from 0
    without gaps; grown_shard is the shard under the tree more, or null. A null text has no bytes and the checksum 0. A null
    doc_id is one more key. Repeated rows share a shard and get a slot each. Other columns are ignored; an empty table
    gives an empty result.

    Cost: one shuffle of short rows. Slots are numbered within cells of a shard, by hash of the id, and a sum over the
    counts of the shards times cells (a fixed, small number) gives each cell its first slot: no task sees a whole shard.
    """
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        (shard_of(F.col("doc_id"), more) if more else F.lit(None)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)).cast("int").alias("cell"),
    )
    # the counts reach one task as shards x cells rows at most, whatever the input
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(first, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = layout(40)
    out = assign_shards(table(spark, sf_dir, "documents"), tree, grown(tree))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
