"""Personal data: the patterns against plain ones, the terms against what was planted."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import regex

from brindle.llm import pii

from .conftest import prose, rows_by_id, texts_of

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


CHECKS = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: luhn(re.sub("[^0-9]", "", s)), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15)


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if CHECKS[k](m[0])]
    return sorted(out)


def told(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark, folder):
    out = rows_by_id(pii.op10_pii(spark, folder))
    texts = texts_of(spark, folder)
    assert out.keys() == texts.keys()
    for i, t in texts.items():
        base, r = brute(t), out[i]
        assert tuple(r[f"n_{k}"] for k in KINDS[:4]) == tuple(sum(k == x for _, k, _ in base) for x in range(4)), i
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        assert set(filter(None, told(base).split(","))) <= set(r["spans"].split(","))


EDGES = [
    "a@b.c@d.e", "foo@bar@baz.com", "a@b.c_d@e.f", "x@y", "@a.b", "a@b..c", "%+-.@a-b.c-d.e,", "é@b.c", "a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.0 00255.1.1.1", "1.2.3", "999.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 9", "41111111111111110", "4111  1111 1111 1111", "12345678901234", "+1 (555) 010-9999", "+123", "++12345678901", "+12345678901234567", "+1.2.3.4.5.6.7.8.9.0 x", "😀 +4930123456789 é", "5.5.5.5" * 3, "1" * 5000,
]


def test_patterns_at_their_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(EDGES)]
    out = rows_by_id(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, found string")))
    for i, t in enumerate(EDGES):
        assert [(s["start"], s["kind"], s["end"]) for s in out[i]["spans"] if s["kind"] < 4] == brute(t), t


def test_many_matches(spark):
    text = " ".join(f"{k % 300}.1.2.{k % 256} u{k}@example.org {k}" for k in range(3000))
    found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["start"], s["kind"], s["end"]) for s in found if s["kind"] < 4] == brute(text)


def people():
    rows = [(k, f"{prose(k, 30)} Zebulon writes from zeb@example.org about {prose(-k, 20)}") for k in range(8)]
    rows += [(100 + k, f"{prose(k + 50, 30)} Ann writes from ann{k}@host{k}.example about {prose(-k, 20)}") for k in range(60)]
    return rows + [(500 + k, prose(k + 900, 60)) for k in range(60)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_revealing_terms(spark, few, monkeypatch):
    monkeypatch.setattr(pii, "FEW", few)
    rows = people()
    out = rows_by_id(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), support=3))
    texts = dict(rows)
    terms = {i: {texts[i][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 4} for i, r in out.items()}
    assert all(terms[k] == {"Zebulon"} for k in range(8))
    assert not any(terms[i] for i in terms if i >= 100)


def test_copies_are_one_text(spark):
    """A term that stands beside an entity in copies of one text alone has no support."""
    rows = [(k, f"Zebulon writes from zeb@example.org {prose(1, 30)}") for k in range(8)] + [(50 + k, prose(k, 30)) for k in range(20)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not any(s["kind"] == 4 for r in out.collect() for s in r["spans"])


def test_sanitise(spark):
    rows = people() + [(900, None), (901, ""), (1, "twice a@b.c"), (1, "twice a@b.c")]
    clean = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, s_id string")
    assert pii.sanitise(clean.where("false")).collect() == []
    out = pii.sanitise(clean).collect()
    assert len(out) == len(rows)
    joined = "\n".join(r["text"] for r in out)
    assert "@" not in joined and "Zebulon" not in joined and "[term] writes from [email] about" in joined
    assert sorted(r["text"] for r in out if r["doc_id"] in (1, 900, 901) and "Zeb" not in r["text"] and "[term]" not in r["text"]) == ["", "", "twice [email]", "twice [email]"]


def test_contexts_reach_over_other_matches(spark):
    """Of each valid entity the context is the text beside it, whatever numbers or entities stand in between."""
    texts = ["Zebulon in 2024, room 17: 4111 1111 1111 1111 of 12 34 56 Quentin " + "far " * 40, "😀 " * 50 + "Ann a@b.cd e@f.gh Bob", "12 " * 200 + "x 4111111111111111 y" + " 34" * 200, "4111111111111111", "word " * 40 + "1.2.3.4 5.6.7.8" + " word" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, found in df.select("doc_id", pii._entities(pii.F.col("text"), 80)).collect():
        assert found or i == 3
        for e in found:
            before, after = texts[i][: e["start"]], texts[i][e["end"] :]
            assert e["before"] == (re.sub(r"^[^\W\d_]+", "", before[-80:]) if len(before) > 80 else before)
            assert e["after"] == (re.sub(r"[^\W\d_]+$", "", after[:80]) if len(after) > 80 else after)


def test_terms_beyond_numbers_are_flagged(spark):
    rows = [(k, f"{prose(k, 30)} Zebulon in 2024 pays by 4111 1111 1111 1111 for {prose(-k, 20)}") for k in range(8)]
    rows += [(500 + k, prose(k + 900, 60)) for k in range(60)]
    out, texts = rows_by_id(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))), dict(rows)
    assert all("Zebulon" in {texts[i][s["start"] : s["end"]] for s in out[i]["spans"] if s["kind"] == 4} for i in range(8))


def brute_terms(rows, disclosure=0.9, support=2, context=80):
    """doc_id to the terms to be flagged, by the formula, over all rows (of different doc_ids)."""
    beside, n_term, both, with_entity, seen = defaultdict(set), Counter(), Counter(), defaultdict(set), defaultdict(set)
    terms = lambda s: set(regex.findall(r"\p{L}{4,}", s.lower()))
    for i, t in rows:
        n_term.update(terms(t or ""))
        for a, k, b in brute(t):
            value, digits = t[a:b].lower(), re.sub("[^0-9]", "", t[a:b])
            before, after = t[:a], t[b:]
            before = regex.sub(r"^\p{L}+", "", before[-context:]) if len(before) > context else before
            after = regex.sub(r"\p{L}+$", "", after[:context]) if len(after) > context else after
            group = [value.split("@")[-1], value.rpartition(".")[0], digits[:6], digits[:-7]][k]
            for e in ((k, 0, digits if k >= 2 else value), (k, 1, group)):
                beside[i] |= {(e, w) for w in terms(before + " " + after)}
    for i, t in rows:
        for e, w in beside[i]:
            both[e, w] += 1
            with_entity[e].add(i)
            seen[e, w].add(t)
    n, out = len(rows), defaultdict(set)
    for i, found in beside.items():
        for e, w in found:
            if len(seen[e, w]) >= support and len(with_entity[e]) < n and 1 - math.log(both[e, w] / n_term[w]) / math.log(len(with_entity[e]) / n) >= disclosure:
                out[i].add(w)
    return out


def flagged(out, texts):
    return {i: {texts[i][s["start"] : s["end"]].lower() for s in r["spans"] if s["kind"] == 4} for i, r in out.items()}


def test_terms_are_brute_force(spark, folder):
    texts = texts_of(spark, folder)
    out = rows_by_id(pii.find_pii(spark.read.parquet(f"{folder}/documents.parquet")))
    expected = brute_terms([*texts.items()])
    assert flagged(out, texts) == {i: expected[i] for i in texts}


def groups_of_people():
    """A domain, a network, an issuer and an area that no value repeats in, each with a term of its own and with common ones."""
    rows = []
    for k in range(6):
        rows.append((k, f"{prose(k, 25)} Quorum office kim{k}@quorum.example {prose(-k, 20)}"))
        rows.append((10 + k, f"{prose(k + 10, 25)} server Wyvern at 10.77.3.{k} {prose(-k, 20)}"))
        rows.append((20 + k, f"{prose(k + 20, 25)} Larkspur bank {['4000001111111111', '4000002222222222'][k % 2]} {prose(-k, 20)}"))
        rows.append((30 + k, f"{prose(k + 30, 25)} Ferndale shop +1 (555) 010-{1000 + k} {prose(-k, 20)}"))
        rows.append((40 + k, f"{prose(k + 40, 25)} server shop office bank {prose(-k, 20)}"))
    return rows + [(100 + k, prose(k + 900, 60)) for k in range(60)] + [(200, None), (201, ""), (202, "ÉTÉ Wyvern 10.77.3.9 " + "😀" * 90)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_terms_that_reveal_a_group(spark, few, monkeypatch):
    monkeypatch.setattr(pii, "FEW", few)
    rows = groups_of_people()
    texts = dict(rows)
    found = flagged(rows_by_id(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))), texts)
    expected = brute_terms(rows)
    assert found == {i: expected[i] for i, _ in rows}
    assert all("quorum" in found[k] and "wyvern" in found[10 + k] and "ferndale" in found[30 + k] for k in range(6))
    assert not any(found[i] for i in texts if 40 <= i < 202)


@pytest.mark.parametrize("few", [0, 100_000])
def test_frequencies_count_different_rows(spark, few, monkeypatch):
    monkeypatch.setattr(pii, "FEW", few)
    rows = [(1, 7, "alpha beta alpha"), (1, 7, "alpha beta alpha"), (1, 8, "alpha"), (None, 7, "beta"), (None, 7, "beta"), (None, 7, "beta"), (2, 9, "beta gamma"), (3, 1, None)]
    words = spark.createDataFrame(rows, "doc_id long, row long, text string").repartition(3)
    wanted = spark.createDataFrame([("alpha",), ("beta",), ("delta",)], "term string")
    assert {r["term"]: r["n_term"] for r in pii._frequencies(words, wanted).collect()} == {"alpha": 2, "beta": 3}


def test_terms_do_not_move_with_rows(spark):
    """What is shuffled for the frequencies grows with the terms, not with the rows that hold them."""
    words = spark.range(2000).selectExpr("id AS doc_id", "id AS row", "'stone river cloud amber' AS text")
    wanted = spark.createDataFrame([(w,) for w in "stone river cloud amber".split()], "term string")
    told = pii._frequencies(words, pii.F.broadcast(wanted))
    assert {tuple(r) for r in told.collect()} == {(w, 2000) for w in "stone river cloud amber".split()}
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan.split("Generate")[0]
