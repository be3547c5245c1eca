"""Quality rules: fixed limits, then robust multivariate outliers.

Each text has a vector of transformed statistics. For each language and source the minimum-covariance-determinant estimate
of the vectors' centre and scatter is found by concentration steps over all its documents, from two starts: medians and deviations,
and the mean and covariance of all. Again and again comes the mean and covariance of the part of documents that is nearest by Mahalanobis
distance, until no determinant falls; the least counts. Documents farther than the cutoff are rejected.
"""

from __future__ import annotations

from collections import Counter
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, SMALL, apart, bind, packed, saved, small, table, text_key

_SYMBOLS = "#*$%&|<>"
#: The vector: log of the mean word length, root of symbols a word, arcsines of the roots of the shares of repeated lines and
#: words, log of the number of words. Each with the least standard deviation it is taken to have, which is added to the scatter's diagonal: texts differ
#: that much for no fault of theirs, and a statistic that is 0 for most documents would else make any other value an outlier. So repetition alone
#: seldom rejects what the fixed limits let pass: with all else usual it takes the repeated share of nearly all lines.
FLOORS = (0.08, 0.06, 0.25, 0.25, 0.8)
_P = len(FLOORS)


def statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    words = text.encode().split()
    n = len(words)
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            again = np.fromiter([counts[w] > 1 for w in windows], bool, n - 2)
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k : n - 2 + k] |= again
            repeated = int(hit.sum())
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, _SYMBOLS)), duplicates, repeated, lines


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _measure(batches):
    for b in batches:
        rows = [statistics(t) for t in b.column(4).to_pylist()]
        yield pa.record_batch([*b.columns[:4], *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_NAMES))]], names=["doc_id", "row", "lang", "source", *_NAMES])


def _chi2(x: float, p: int) -> float:
    """The distribution function of chi-squared with p degrees of freedom."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    for n in range(1, 1000):
        term *= x / (a + n)
        total += term
    return total * exp(-x + a * log(x) - lgamma(a))


def _consistent(part: float) -> float:
    """What makes the scatter of the nearest part of normal vectors that of all."""
    low, high = 1e-6, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, _P) < part else (low, mid)
    return part / _chi2(low, _P + 2)


def _solved(factor: float):
    """From counts, sums and sums of products to centre, inverse scatter and log determinant."""

    def run(batches):
        for b in batches:
            out = []
            for n, s, q in zip(b["n"], b["s"], b["q"]):
                mean = np.array(s, float) / n
                cov = np.array(q, float).reshape(_P, _P) / n - np.outer(mean, mean)
                cov = cov * factor
                cov[np.diag_indices(_P)] = np.maximum(np.diag(cov), 0) + np.square(FLOORS)
                out.append((mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame({"cell": b["cell"], "start": b["start"], "mean": [o[0] for o in out], "inverse": [o[1] for o in out], "logdet": [o[2] for o in out]})

    return run


_MODEL = "cell long, start int, mean array<double>, inverse array<double>, logdet double"


def _distance(v: Column, mean: Column, inverse: Column) -> Column:
    d = [F.get(v, i) - F.get(mean, i) for i in range(_P)]
    return bind(F.array(*d), lambda x: sum((F.get(inverse, i * _P + j) * F.get(x, i) * F.get(x, j) for i in range(_P) for j in range(_P)), F.lit(0.0)))


def _cells(vectors: DataFrame, least: int) -> DataFrame:
    """lang, source and cell for each language and source: its own, or if it has fewer than least documents one that
    the small ones of its language share, or of all languages; where these have too few as well the largest of its language, else of all.
    Null if no language and source, and not all together, have least documents."""
    own = F.xxhash64(F.lit(0), F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    n = vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("own", own)
    small = F.col("n") < least
    by_lang = n.groupBy("lang").agg(F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("n_lang"), F.max_by(F.when(~small, F.col("own")), F.when(~small, F.struct("n", "own"))).alias("largest"))
    by_lang = by_lang.select(F.col("lang").alias("small_lang"), "n_lang", "largest")
    rest = by_lang.where(F.col("n_lang") < least).agg(F.coalesce(F.sum("n_lang"), F.lit(0)).alias("n_rest")).first()[0]
    shared = F.xxhash64(F.lit(1), F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")))
    known = n.where(~small).select("own", "n").unionByName(by_lang.where(F.col("n_lang") >= least).select(F.col("small_lang").alias("lang"), F.col("n_lang").alias("n")).select(shared.alias("own"), "n"))
    most = known.agg(F.max_by("own", F.struct("n", "own"))).first()[0]
    other = F.xxhash64(F.lit(2)) if rest >= least else F.coalesce("largest", F.lit(most).cast("long"))
    n = n.join(by_lang, F.col("lang").eqNullSafe(F.col("small_lang")), "left")
    return n.select(F.col("lang").alias("c_lang"), F.col("source").alias("c_source"), F.when(~small, F.col("own")).when(F.col("n_lang") >= least, shared).otherwise(other).alias("cell"))


def judge(docs: DataFrame, part: float = 0.75, cutoff: float = 36.0, least: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, row (a hash of the text), the statistics, base_failed, distance, kept.

    base_failed: fewer than 50 words, or over half the words stand in 3-word windows found twice or more. The others are judged by
    the squared Mahalanobis distance from the estimate of their language and source, which all of them that didn't fail make; over
    cutoff (chi-squared with 5 degrees of freedom exceeds 36 once in a million times) they go. A language and source with
    fewer than least documents is estimated together with the other small ones of its language, these if too few
    with those of other languages, and if they are still too few with the largest language and source. With fewer than least documents in all
    there is no estimate: those that didn't fail are kept and their distance is null.

    A null or empty text has no words and fails. Null languages and sources are values like others. Repeated rows all come
    back, and count as often as they stand. Other columns are ignored; an empty table gives an empty result.

    Cost: texts are read once and never move; the statistics go to the checkpoint folder. A step is two aggregations,
    map-side first, into a few dozen numbers for each language and source.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("row"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    out = rows.mapInArrow(_measure, "doc_id long, row long, lang string, source string, " + ", ".join(f"{x} long" for x in _NAMES))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / b)))
    vector = F.array(F.log(F.greatest("word_chars", F.lit(1)) / words), F.sqrt(F.col("n_symbols") / words), share("n_dup_lines", lines), share("n_repeat_words", words), F.log1p("n_words"))
    out = saved(out.withColumn("v", vector))

    good = out.where(~F.col("base_failed"))
    cells = saved(_cells(good, least))
    in_cell = F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("source").eqNullSafe(F.col("c_source"))
    named = cells.count()
    told = lambda df: F.broadcast(df) if named <= SMALL else df  # noqa: E731  a row for each language and source
    own = lambda df: small(df, "cell", named)
    vectors = good.join(told(cells.where(F.col("cell").isNotNull())), in_cell).select("cell", "v")

    medians = vectors.groupBy("cell").agg(F.array(*[F.percentile_approx(F.get("v", i), 0.5, 1000) for i in range(_P)]).alias("mean"))
    spread = vectors.join(own(medians), "cell").groupBy("cell", "mean").agg(F.array(*[F.percentile_approx(F.abs(F.get("v", i) - F.get("mean", i)), 0.5, 1000) for i in range(_P)]).alias("mad"))
    inverse = F.array(*[(1 / (F.pow(F.get("mad", i) * 1.4826, 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)) for i in range(_P) for j in range(_P)])

    def solved(near: DataFrame, factor: float) -> DataFrame:
        """Mean, inverse scatter and log determinant for each cell and start of near."""
        sums = near.groupBy("cell", "start").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(F.get("v", i)) for i in range(_P)]).alias("s"), F.array(*[F.sum(F.get("v", i) * F.get("v", j)) for i in range(_P) for j in range(_P)]).alias("q")
        )
        return sums.mapInPandas(_solved(factor), _MODEL)

    start = spread.select("cell", F.lit(0).alias("start"), "mean", inverse.alias("inverse"), F.lit(float("inf")).alias("logdet"))
    wide = solved(vectors.withColumn("start", F.lit(1)), 1.0).withColumn("logdet", F.lit(float("inf")))
    model = best = saved(start.unionByName(wide))
    factor = _consistent(part)
    while True:
        near = vectors.join(own(model), "cell").select("cell", "start", "v", _distance(F.col("v"), F.col("mean"), F.col("inverse")).alias("d"))
        limits = near.groupBy("cell", "start").agg(F.percentile_approx("d", part, 10000).alias("limit"))
        limits = F.broadcast(limits) if named <= SMALL else limits.withColumn("cell", apart(F.col("cell")))
        model = saved(solved(near.join(limits, ["cell", "start"]).where(F.col("d") <= F.col("limit")), factor))
        both = best.withColumn("new", F.lit(0)).unionByName(model.withColumn("new", F.lit(1)))
        # a later one counts where it is better; that ends, since determinants have a bound
        ahead = saved(both.groupBy("cell", "start").agg(F.min_by(F.struct("mean", "inverse", "logdet", "new"), F.struct(F.col("logdet") + F.when(F.col("new") == 1, 1e-3).otherwise(0.0), "new")).alias("m")))
        best = ahead.select("cell", "start", "m.mean", "m.inverse", "m.logdet")
        if not ahead.agg(F.max("m.new")).first()[0]:
            break
    model = best.groupBy("cell").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("m")).select("cell", "m.mean", "m.inverse")
    judged = cells.join(model, "cell", "left").select("c_lang", "c_source", "mean", "inverse")
    out = out.join(told(judged), in_cell, "left")
    distance = F.when(~F.col("base_failed"), _distance(F.col("v"), F.col("mean"), F.col("inverse")))
    out = out.select("doc_id", "row", *_NAMES, "base_failed", distance.alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cutoff)))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that judge() rejects, whole as they were.

    Null and empty texts go. Repeated rows stay or go together; rows that share a doc_id are judged each by its own text. Other columns may have any name; an
    empty table gives an empty result. Texts move once, to their verdicts.
    """
    verdicts = judge(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row"))
    rows = packed(docs, id_col, text_col)
    kept = rows.join(verdicts, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row")), "left_semi")
    return kept.select("doc.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
