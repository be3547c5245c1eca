"""The weighted hash tree: laws of the assignment."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm import sharding
from brindle.llm.sharding import Node, assign_shards, grown, layout, shard_of

from .conftest import texts_of


def test_contract(spark, folder):
    out = sharding.op7_sharding(spark, folder).collect()
    texts = texts_of(spark, folder)
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    slots = {}
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def drawn(spark, tree, n=20_000):
    return {r["id"]: r["s"] for r in spark.range(n).select("id", shard_of(F.col("id"), tree).alias("s")).collect()}


def test_rows_follow_weights(spark):
    tree = Node("root", 1, (Node("a", 3.0, (Node("a0", 1.0, shard=0), Node("a1", 2.0, shard=1))), Node("b", 1.0, (Node("b2", 1.0, shard=2), Node("off", 0.0, shard=3)))))
    n = Counter(drawn(spark, tree).values())
    assert 3 not in n
    for s, share in {0: 0.25, 1: 0.5, 2: 0.25}.items():
        assert abs(n[s] / 20_000 - share) < 0.015


def test_movement_stays_in_the_subtree(spark):
    a, b = (Node("a", 1.0, (Node("a0", 1.0, shard=0), Node("a1", w, shard=1))) for w in (1.0, 3.0))
    rest = Node("b", 1.0, (Node("b2", 1.0, shard=2), Node("b3", 1.0, shard=3)))
    before, after = drawn(spark, Node("r", 2, (a, rest))), drawn(spark, Node("r", 2, (b, rest)))
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    assert moved == {(0, 1)}


@pytest.mark.parametrize("n", [1, 7, 40, 43])
def test_one_more_shard_takes_rows_into_itself(spark, n):
    tree = layout(n)
    assert sorted(tree.shards()) == list(range(n))
    before, after = drawn(spark, tree), drawn(spark, grown(tree))
    moved = [after[i] for i in before if before[i] != after[i]]
    assert set(moved) == {n} and abs(len(moved) / 20_000 - 1 / (n + 1)) < 0.02
    counts = Counter(before.values())
    assert len(counts) == n and max(counts.values()) < 1.5 * 20_000 / n


def test_growing_is_the_next_layout(spark):
    assert drawn(spark, grown(layout(40)), 5000) == drawn(spark, layout(41), 5000)


def test_repeats_nulls_and_one_hot_text(spark):
    rows = [(5, "same", 1)] * 3 + [(None, None, 2)] * 2 + [(k, "hot", 3) for k in range(100, 400)]
    out = assign_shards(spark.createDataFrame(rows, "doc_id long, text string, slot int"), layout(3), cells=4).collect()
    assert len(out) == len(rows)
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] is None} == {(16, 0)}
    assert {r["grown_shard"] for r in out} == {None}


def test_broken_trees(spark):
    with pytest.raises(ValueError):
        layout(0)
    with pytest.raises(ValueError):
        shard_of(F.lit(1), Node("a", 1, (Node("b", 0.0, shard=0),)))
    with pytest.raises(ValueError):
        shard_of(F.lit(1), Node("a", 1, (Node("b", 1.0, shard=0), Node("b", 1.0, shard=1))))
