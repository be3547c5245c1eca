"""Line dedup, substring dedup and benchmark decontamination against brute force."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brindle.llm.decontaminate import decontaminate, keep_clean
from brindle.llm.line_dedup import drop_lines, line_dedup
from brindle.llm.substring_dedup import substring_dedup

from .conftest import prose

some = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_lines(rows, min_chars, min_docs):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    # a null id is below all others
    most = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if most.get(lower(x.strip(" \t\n\x0b\x0c\r")), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = st.lists(st.sampled_from(["", "a", "AB", " ab\t", "abc", "é", "Abc "]), max_size=6).map("\n".join)


@some
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), LINES)), max_size=12))
def test_line_dedup_is_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(2)
    out = line_dedup(df, min_chars=2, min_docs=2)
    assert sorted(map(tuple, out.collect()), key=str) == brute_lines(rows, 2, 2)


def test_drop_lines_keeps_the_rest(spark):
    rows = [(k, f"shared line\n{k}", "x", k) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, `row` int")
    out = drop_lines(df, min_chars=5, min_docs=2)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(0, "0", "x", 0), (1, "1", "x", 1), (2, "shared line\n2", "x", 2)]


def brute_passages(rows, window):
    big = 1 << 63
    first = {}
    words = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, big), big - 1 if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (big - 1 if i is None else i):
                gone.update(range(s, s + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


@some
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.text("ab \n", max_size=60))), max_size=12), st.integers(2, 5))
def test_substring_dedup_is_brute_force(spark, rows, window):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, words int").repartition(2)
    out = substring_dedup(df, window=window).select("doc_id", "text", "n_words", "n_removed")
    assert sorted(map(tuple, out.collect()), key=str) == brute_passages(rows, window)


def test_substring_dedup_of_long_texts(spark):
    shared = prose("s", 500)
    rows = [(k, f"{prose(k, 700)} {shared} {prose(-k - 1, 300)}") for k in range(4)] + [(9, prose(0, 700))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup(df).select("doc_id", "text", "n_words", "n_removed")
    assert sorted(map(tuple, out.collect()), key=str) == brute_passages(rows, 50)


def test_substring_dedup_of_pieces(spark, monkeypatch):
    """Texts that are hashed in several pieces, one of 30,000 words among them."""
    from brindle.llm import substring_dedup as module

    monkeypatch.setattr(module, "_PIECE", 64)
    shared = prose("p", 200)
    rows = [(1, f"{prose(1, 300)} {shared}"), (2, f"{prose(2, 40)} {shared} {prose(3, 100)} {shared}"), (3, f"{prose(4, 15_000)} {shared} {prose(5, 15_000)}")]
    hasher = module.Hasher(50)
    texts = [t.encode().split() for _, t in rows]
    starts = [sorted(s for x in hasher.short(w) for a, b in zip(x[-2].tolist(), x[-1].tolist()) for s in range(a, b + 1)) for w in texts]
    assert starts == [list(range(len(w) - 49)) for w in texts]  # every whole window is in one chain
    at, data = hasher.whole(texts[1], [(10, 70), (60, 200)])
    assert at.tolist() == list(range(10, 201)) and data[16:32] == module.xxhash.xxh3_128_digest(b" ".join(texts[1][11:61]))
    monkeypatch.undo()
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_words", "n_removed")
    assert sorted(map(tuple, out.collect()), key=str) == brute_passages(rows, 50)


@pytest.mark.parametrize("window", [2, 3, 4, 5, 7, 13, 50, 51, 100])
def test_chains_cover_every_place_once_and_stay_inside(window):
    from brindle.llm.substring_dedup import chains_of, lengths_of

    lengths = lengths_of(window)
    assert lengths[-1] == window and all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:]))
    chains = chains_of(lengths)
    assert sorted(o for c in chains for o in range(c.low, c.high + 1)) == list(range(window - lengths[0] + 1))
    assert all(0 <= o - a and o - a + n <= window for c in chains for o in (c.low, c.high) for a, n in zip(c.left, lengths))


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) if w]


def brute_hits(rows, items, width):
    wins = {}
    for item, t in items:
        w = words(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add("null" if item is None else str(item))
    sizes = {len(k) for k in wins}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if names := wins.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


TOKENS = st.text("aB.é ", max_size=40)


@some
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), TOKENS)), max_size=8), st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), TOKENS)), max_size=5), st.integers(3, 6))
def test_decontaminate_is_brute_force(spark, rows, items, width):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(2)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    out = decontaminate(docs, bench, width=width, k=2).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert sorted(map(tuple, out.collect()), key=str) == brute_hits(rows, items, width)


def test_places_beyond_their_bits(spark, monkeypatch):
    """A text with more words than a place has room for: with 5 bits, and 30,000 words, of which some are an item's."""
    from brindle.llm import decontaminate as module

    monkeypatch.setattr(module, "_PLACE", 5)
    item = prose("item", 60)
    rows = [(1, f"{prose(1, 90)} {' '.join(item.split()[5:30])} {prose(2, 50)} one two"), (2, f"{prose(3, 15_000)} {' '.join(item.split()[20:40])} {prose(4, 15_000)}"), (3, item), (4, "one two " * 40)]
    items = [(1, item), (2, "one two")]
    out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert sorted(map(tuple, out.collect()), key=str) == brute_hits(rows, items, 13)


def test_winnowing_finds_every_span(spark):
    item = prose("item", 200)
    w = item.split()
    rows = [(k, f"{prose(k, 50)} {' '.join(w[k : k + 13])} {prose(-k - 1, 50)}") for k in range(0, 187)]
    out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r["n_hit"] >= 13 and r["contaminated"] for r in out.collect()] == [True] * len(rows)


def test_keep_clean(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (1, "x y z", 2), (2, None, 3), (None, "a b c", 4)], "doc_id long, text string, bad_id int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert sorted(r["bad_id"] for r in keep_clean(docs, bench).collect()) == [2, 3]


def test_keep_clean_drops_a_whole_window_in_a_long_text(spark):
    """One window of 13 words in 1,000 isn't contamination by share, but the row goes; 12 words of it, or a short item's, leave it."""
    item = prose("item", 40).split()
    long = lambda k, n: f"{prose(k, 500)} {' '.join(item[k : k + n])} {prose(-k - 1, 500)}"
    rows = [*((k, long(k, 13)) for k in range(6)), *((10 + k, long(k, 12)) for k in range(6)), (20, f"{prose(20, 700)} qqq www"), (21, "qqq www eee"), (22, None), (23, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, full string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "qqq www")], "item_id long, text string")
    out = keep_clean(docs, bench)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [*range(10, 16), 20, 22, 23]
    assert keep_clean(docs.where("false"), bench).count() == 0 and keep_clean(docs, bench.where("false")).count() == len(rows)


def test_a_window_of_one_word_is_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup(spark.createDataFrame([], "doc_id long, text string"), window=1)
