"""Quality rules: the statistics against brute force, the outliers against what was planted and a plain estimate."""

import random
import re
from collections import Counter

import numpy as np

from brindle.llm import quality

from .conftest import prose, rows_by_id, texts_of


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n, lines, seen = len(words), 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated), failed


def test_statistics(spark, folder):
    out = rows_by_id(quality.op5_quality(spark, folder))
    texts = texts_of(spark, folder)
    assert out.keys() == texts.keys()
    for i, t in texts.items():
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), i
        assert not (r["base_failed"] and r["kept"])


def documents(n=600):
    rows = [(k, prose(k, 100 + random.Random(k).randrange(400)), ["en", "de"][k % 2], ["web", "book"][k % 3 == 0]) for k in range(n)]
    junk = [(10_000 + k, " ".join("#$%" * 3 + w for w in prose(k, 200).split()), "en", "web") for k in range(20)]
    junk += [(11_000 + k, " ".join("q" * 60 + str(j) for j in range(200)), "de", "web") for k in range(20)]
    return rows, junk


def test_outliers_go_and_clean_ones_stay(spark):
    rows, junk = documents()
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string").repartition(4)
    out = rows_by_id(quality.judge(df))
    assert not any(out[i]["kept"] for i, *_ in junk)
    assert sum(out[i]["kept"] for i, *_ in rows) >= 0.99 * len(rows)


def vectors_of(out):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    x = np.array([[r[c] for c in names] for r in out], float)
    w, lines = np.maximum(x[:, 0], 1), np.maximum(x[:, 5], 1)
    return np.stack([np.log(np.maximum(x[:, 1], 1) / w), np.sqrt(x[:, 2] / w), np.arcsin(np.sqrt(np.minimum(1, x[:, 3] / lines))), np.arcsin(np.sqrt(x[:, 4] / w)), np.log1p(x[:, 0])], 1)


def plain_distances(v, part=0.75):
    """The minimum-covariance-determinant estimate by concentration from the same two starts, in memory; squared distances and the log determinant."""

    def distances(mean, cov):
        return np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)

    def estimate(x, factor):
        return x.mean(0), np.cov(x.T, bias=True) * factor + np.diag(np.square(quality.FLOORS))

    medians, found = np.median(v, 0), []
    mad = np.median(np.abs(v - medians), 0) * 1.4826
    for model in ((medians, np.diag(mad**2 + np.square(quality.FLOORS))), estimate(v, 1.0)):
        best = np.inf
        while True:
            d = distances(*model)
            model = estimate(v[d <= np.quantile(d, part, method="inverted_cdf")], quality._consistent(part))
            now = np.linalg.slogdet(model[1])[1]
            if now > best - 1e-3:
                break
            best, kept = now, model
        found.append((best, kept))
    best, kept = min(found, key=lambda x: x[0])
    return distances(*kept), best


def test_verdicts_are_those_of_a_plain_estimate(spark):
    """Every group's distances and verdicts, whole output, against the estimate in memory."""
    rows, junk = documents(400)
    schema = "doc_id long, text string, lang string, source string"
    groups = {r[0]: r[2:] for r in rows + junk}
    out = [r for r in quality.judge(spark.createDataFrame(rows + junk, schema).repartition(3)).collect() if not r["base_failed"]]
    assert len(out) > 400
    for g in set(groups.values()):
        own = [r for r in out if groups[r["doc_id"]] == g]
        d, _ = plain_distances(vectors_of(own))
        # the quantile is an approximate one on either side, so a document on the edge may count or not
        assert np.allclose([r["distance"] for r in own], d, rtol=0.1, atol=0.3), g
        assert [r["kept"] for r in own] == (d <= 36).tolist()


def test_small_groups_share_and_none_is_kept(spark):
    schema = "doc_id long, text string, lang string, source string"
    few = [(k, prose(k, 100), "en", f"s{k}") for k in range(20)]
    out = quality.judge(spark.createDataFrame(few, schema))
    assert all(r["kept"] and r["distance"] is None for r in out.collect())
    shared = [(k, prose(k, 100), "en", f"s{k % 9}") for k in range(150)]
    # a remainder too small for an estimate of its own is judged by the largest group
    shared += [(500, prose(500, 100), "fr", "alone"), (501, " ".join("#$%" * 3 + w for w in prose(501, 200).split()), None, None)]
    out = rows_by_id(quality.judge(spark.createDataFrame(shared, schema)))
    assert all(r["distance"] is not None and r["kept"] == (i != 501) for i, r in out.items())


def test_groups_over_the_broadcast_bound(spark, monkeypatch):
    rows, junk = documents(300)
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    told = lambda: {i: (r["kept"], r["distance"] and round(r["distance"], 6)) for i, r in rows_by_id(quality.judge(df)).items()}
    small = told()
    monkeypatch.setattr(quality, "SMALL", 0)
    monkeypatch.setattr("brindle.llm.common.SMALL", 0)
    assert told() == small


def test_keep_good_keeps_whole_rows(spark):
    rows = [(1, prose(1, 80), None, None, 7), (1, prose(1, 80), None, None, 8), (2, "short", "en", "web", 9), (None, None, None, None, 10), (None, prose(3, 80), "en", None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept_id int")
    out = quality.keep_good(df)
    assert out.columns == df.columns and sorted(r["kept_id"] for r in out.collect()) == [7, 8, 11]
