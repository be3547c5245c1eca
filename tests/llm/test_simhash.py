"""SimHash near-dedup against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from brindle.llm import components as rounds
from brindle.llm import simhash
from brindle.llm.components import components

from .conftest import prose, rows_by_id, texts_of


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_matches_all_pairs(spark, folder):
    texts = texts_of(spark, folder)
    marks = {i: fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    expected = roots(ids, [(a, b) for a in ids for b in ids if a < b and (marks[a] ^ marks[b]).bit_count() <= 4])
    out = rows_by_id(simhash.op3_simhash(spark, folder))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {i: (f"{marks[i]:016x}", expected[i]) for i in ids}


def crowded(n, seed=0):
    """Random fingerprints, some at 1 to 6 bits from others, and a crowd around zero."""
    r = np.random.default_rng(seed)
    marks = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
    out = [marks]
    for bits in range(1, 7):
        flips = np.array([sum(1 << int(b) for b in r.choice(64, bits, replace=False)) for _ in range(n // 10)], np.uint64)
        out.append(marks[: n // 10] ^ flips)
    out.append(np.array([sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(n // 4)], np.uint64))
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("blocks,chosen", [(None, 1), (3, 1), (6, 2)])
def test_trees_miss_no_link(spark, blocks, chosen):
    """Small leaves and a low bound on shards: many levels, chunks, and for three blocks boundary copies."""
    marks = crowded(2000)
    near = []
    for k in range(len(marks)):
        d = np.bitwise_count(marks[k] ^ marks[k + 1 :])
        near += [(int(marks[k]), int(marks[k + 1 + j])) for j in np.flatnonzero(d <= 4)]
    expected = roots([int(m) for m in marks], near)
    df = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "mark long").repartition(3)
    edges = simhash.links(df, blocks=blocks, chosen=chosen, leaf=30, most=100)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    group = lambda m: found.get(m, m)
    signed = {int(a): int(b) for a, b in zip(marks, marks.view(np.int64))}
    by_found, by_expected = {}, {}
    for m in map(int, marks):
        by_found.setdefault(group(signed[m]), set()).add(m)
        by_expected.setdefault(expected[m], set()).add(m)
    assert sorted(map(sorted, by_found.values())) == sorted(map(sorted, by_expected.values()))


def test_slack_is_the_worst_case():
    r = np.random.default_rng(1)
    for blocks, chosen in ((3, 1), (5, 1), (6, 2), (7, 3), (4, 2)):
        worst = max(int(np.sort(np.bincount(r.integers(0, blocks, 4), minlength=blocks))[:chosen].sum()) for _ in range(3000))
        assert simhash.slack_of(4, blocks, chosen) == worst


def test_copies_do_not_grow_with_the_input():
    """Rows dealt for a mark are the number of trees, whatever the depth; medians of the data part them evenly enough."""
    r = np.random.default_rng(2)
    dealt = {}
    for n in (10_000, 1_000_000):
        marks = r.integers(0, 1 << 63, n, dtype=np.uint64)
        trees = simhash.trees_of(4, *simhash.planned(n, 4, 1000))
        for t in trees:
            t.splits = [int(np.median(t.distances(marks, k))) for k in range(len(t.points))]
        sizes = [np.unique(t.shards(marks)[1], return_counts=True)[1] for t in trees]
        dealt[n] = sum(s.sum() for s in sizes) / n
        assert max(s.max() for s in sizes) < 8192
    assert dealt == {10_000: 5, 1_000_000: 5}
    assert simhash.planned(10**10, 4, 1000)[:2] == (7, 3)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = prose("long", 5000).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert simhash.fingerprint(text) == whole == fingerprint(text.decode())


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 101), (100, 101), (None, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("edges", [100_000, 100])
def test_components_have_as_many_partitions_as_their_edges_need(spark, edges, monkeypatch):
    r = np.random.default_rng(3)
    pairs = [*r.integers(0, 1500, (300, 2)).tolist(), *[(k, k + 1) for k in range(2000, 2010)], *[(5000, 5000 + k) for k in range(1, 200)]]
    monkeypatch.setattr(rounds, "EDGES", edges)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = components(spark.createDataFrame(pairs, "a long, b long"))
        found, partitions = {x["node"]: x["root"] for x in out.collect()}, out.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == roots({n for p in pairs if p[0] != p[1] for n in p}, pairs)
    if edges > len(pairs):
        assert partitions <= 2  # two parts of 16 before


def test_near_dedup_keeps_one(spark):
    base = prose("base", 600)
    rows = [(5, base, 1), (3, base, 2), (3, base, 3), (7, base + " more", 4), (None, base, 5), (9, prose("other", 600), 6), (11, None, 7), (12, "", 8), (None, prose("alone", 600), 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id int")
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    kept = sorted(r["keep_id"] for r in out.collect())
    assert len(kept) == 4 and kept[0] in (2, 3) and kept[1:] == [6, 7, 9]
