"""Near copies by exact similarity, against all pairs; their fingerprints are too far apart for SimHash's links."""

import random

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import similar, simhash
from brindle.llm.components import components

from .conftest import prose
from .test_simhash import roots


def sets(text):
    w = (text or "").lower().split()
    return set(zip(*[w[k:] for k in range(5)])) or ({tuple(w)} if w else set())


def edited(text, seed, n):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), n):
        words[i] = f"edit{r.random()}"
    return " ".join(words)


def near_copies():
    rows, i = [], 0
    for k in range(12):
        base = prose(1000 + k, 300)
        for t in [base, *(edited(base, f"{k}:{m}", m) for m in (2, 3, 4, 5, 6, 7, 9, 15))]:
            rows.append((i := i + 1, t))
    return [*rows, (500, None), (501, " \n"), (502, "few words"), (503, "FEW  words"), (504, "other words"), (505, prose(1000, 300))]


def pairs(rows, least=0.8):
    s = {i: sets(t) for i, t in rows}
    return [(a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) >= least * len(s[a] | s[b])]


@pytest.mark.parametrize("few,texts", [(500_000, 1024), (0, 8)])
def test_links_connect_what_all_pairs_do(spark, few, texts, monkeypatch):
    """Also where texts are found without a broadcast, and chunks are so small that every bucket has several."""
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "_TEXTS", texts)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = {r["doc_id"]: r["row"] for r in simhash.fingerprints(df).collect()}
    found = {r["node"]: r["root"] for r in components(similar.similar_links(df)).collect()}
    expected, groups = roots([i for i, _ in rows], pairs(rows)), {}
    for i, _ in rows:
        groups.setdefault(found.get(keys[i], keys[i]), set()).add(i)
    wanted = {}
    for i, root in expected.items():
        wanted.setdefault(root, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_stage_drops_near_copies_far_in_bits(spark):
    rows = near_copies()[:-6]
    far = [(a, b) for a, b in pairs(rows) if (simhash.fingerprint(dict(rows)[a].encode()) ^ simhash.fingerprint(dict(rows)[b].encode())).bit_count() > 4]
    assert far
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert not [p for p in pairs(rows) if kept.issuperset(p)]


def test_no_pair_of_a_bucket_is_left_unchecked(spark):
    """All texts in one bucket, where the least is like none of the others."""
    base = prose(7, 300)
    rows = [(k, t) for k, t in enumerate([*(prose(50 + k, 300) for k in range(12)), base, edited(base, 1, 3), edited(base, 2, 3)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = similar.similar_links(df, bands=1, rows=0).collect()
    keys = {r["row"]: r["doc_id"] for r in simhash.fingerprints(df).collect()}
    group = roots([i for i, _ in rows], [(keys[r["a"]], keys[r["b"]]) for r in links])
    assert group == roots([i for i, _ in rows], pairs(rows)) and group[14] == group[13] == 12


@pytest.mark.parametrize("listed", [2, 32])
def test_common_counts_are_brute_force(monkeypatch, listed):
    """Rare values, whose pairs are listed, and common ones, which a product of matrices counts."""
    monkeypatch.setattr(similar, "_LISTED", listed)
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60 if k % 2 else 3000, r.integers(0, 90))).astype(np.uint64) for k in range(50)]
    assert similar._common(sets).tolist() == [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    texts = [prose(k % 3, 40 + k).encode() for k in range(6)] + [b"", b" \n", b"one two", b"ONE  two"]
    near = similar.similar_pairs(texts, 5, 0.8)
    words = [t.decode() for t in texts]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = sets_of(a), sets_of(b)
            assert near[i, j] == bool(x and y and len(x & y) >= 0.8 * len(x | y)), (i, j)


sets_of = sets
