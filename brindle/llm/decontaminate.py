"""Benchmark decontamination by winnowing. DataFrame functions only.

Of the hashes of all k-grams in each sliding window the least is kept as a fingerprint. With k-grams of 5 words and
windows of 9 of them, any 13 words that a document and an item share keep the same fingerprint on both sides, so a join of
the fingerprints misses none; each hit is then extended to the windows of 13 words around it, which are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, ascii_lower, bind, packed, table, text_key

#: Low bits of a fingerprint: its place in the text, modulo 2 ** _PLACE. The rest is the hash.
_PLACE = 24
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of ASCII letters and digits, lower-cased, and of all other characters."""
    return F.array_remove(F.split(ascii_lower(text), _GAP), "")


def _prints(words: Column, width: int, k: int) -> Column:
    """Of each width - k + 1 consecutive k-grams the least hash, with its place (from 1) in the low bits; none if words are fewer than width."""
    high, low, span = F.lit(~((1 << _PLACE) - 1)).cast("long"), F.lit((1 << _PLACE) - 1).cast("long"), width - k + 1

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)).bitwiseAND(high).bitwiseOR(i.cast("long").bitwiseAND(low)))

    def least(h: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda i: F.array_min(F.slice(h, i, span))))

    return bind(words, lambda w: F.when(F.size(w) >= width, hashes(w) if span == 1 else bind(hashes(w), least)))


def _marked(rows: DataFrame, keys: list[str], lengths: list[tuple[int, int]], items: bool = False) -> DataFrame:
    """keys, n, print (the hash) and place for each fingerprint of rows' text, for all lengths (words of a window and of a gram) in one scan. Items
    shorter than the first length have fingerprints of their own length alone."""

    def prints(w: Column) -> Column:
        told = []
        for i, (n, k) in enumerate(lengths):
            own = F.transform(_prints(w, n, k), lambda p: F.struct(F.lit(n).alias("n"), p.alias("p")))  # noqa: B023
            told.append(F.coalesce(F.when(F.size(w) == n, own) if items and i else own, F.array().cast("array<struct<n:int,p:bigint>>")))
        return F.concat(*told)

    rows = rows.select(*keys, F.explode(bind(words_of(F.col("text")), prints)).alias("x"))
    return rows.select(*keys, "x.n", F.shiftright("x.p", _PLACE).alias("print"), F.col("x.p").bitwiseAND(F.lit((1 << _PLACE) - 1).cast("long")).cast("int").alias("place"))


def _around(words: Column, places: Column) -> Column:
    """start, n and win of each window that holds one of places in words.

    A place stands for itself and, in texts of over 2 ** _PLACE words, for all that differ by whole multiples of that.
    """

    def starts(p: Column) -> Column:
        first = lambda at: F.greatest(at - p["before"], F.lit(1))
        last = lambda at: F.least(at, F.size(words) - p["n"] + 1)
        ats = F.sequence(p["place"], F.greatest(p["place"], F.size(words)), F.lit(1 << _PLACE))
        one = lambda at: F.when(first(at) <= last(at), F.transform(F.sequence(first(at), last(at)), lambda s: F.struct(s.alias("start"), p["n"].alias("n"))))
        return F.flatten(F.filter(F.transform(ats, one), lambda x: x.isNotNull()))

    return F.transform(
        F.array_distinct(F.flatten(F.transform(places, starts))),
        lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.array_join(F.slice(words, x["start"], x["n"]), " ").alias("win")),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, k: int = 5, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, row (a hash of the text), n_words, n_hit, items (sorted strings), full, contaminated.

    A window is width consecutive words of an item; an item of fewer words, but not none, is one window. A document's
    word inside any occurrence of a window is hit; items are those with a window that occurs; full tells whether one of width
    words does; a document is contaminated if one in one_in of its words is hit, or more.

    A null or empty text has no words, hits nothing and isn't hit. A null item_id is the item "null". Rows of benchmark
    that share an item_id are one item. Repeated documents all come back; rows that share a doc_id alone are judged each by
    its own text. Other columns are ignored. An empty docs gives an empty result; an empty benchmark leaves all clean.

    Cost: texts move once, to the documents with hits. Fingerprints, about 2 in k + 4 words, stay where they are made while
    Spark finds the benchmark's small enough to broadcast, and are shuffled beyond that. Items shorter than width
    need all grams of their length as fingerprints, for each length that occurs, made in the same scan.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("row"), text.alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    items = items.withColumn("n", F.size(words_of(F.col("text")))).where(F.col("n") > 0)
    short = [r[0] for r in items.where(F.col("n") < width).select("n").distinct().collect()]  # width - 1 numbers at most

    lengths = [(width, min(k, width)), *[(n, n) for n in sorted(short)]]
    prints = _marked(items, [], lengths, items=True).select("n", "print").distinct().select("n", apart(F.col("print")).alias("print"))
    before = F.when(F.col("n") == width, F.lit(width - min(k, width))).otherwise(F.lit(0))
    hits = _marked(rows, ["doc_id", "row"], lengths).join(prints, ["n", "print"], "left_semi").select("doc_id", "row", "n", before.alias("before"), "place")
    places = hits.groupBy("doc_id", "row").agg(F.collect_set(F.struct("n", "before", "place")).alias("places"))
    places = places.select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row"), "places")

    near = rows.join(places, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")))
    near = near.select("doc_id", "row", F.explode(bind(words_of(F.col("text")), lambda w: _around(w, F.col("places")))).alias("w")).select("doc_id", "row", "w.start", "w.n", "w.win")

    own = items.select("item", "text", F.least(F.col("n"), F.lit(width)).alias("m"))
    grams = bind(words_of(F.col("text")), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - F.col("m") + 1), lambda s: F.array_join(F.slice(w, s, F.col("m")), " ")))
    own = own.select("item", F.col("m").alias("n"), F.explode(grams).alias("win")).distinct()
    wins = own.select("n", "win").distinct().select("n", F.concat("win", F.lit("")).alias("win"))
    occurs = near.join(wins, ["n", "win"], "left_semi")
    spans = occurs.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    end = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        end,
        lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(s["start"], a["end"]))).alias("hit"), F.greatest(a["end"], s["start"] + s["n"]).alias("end")),
        lambda a: a["hit"],
    )
    full = F.exists("spans", lambda s: s["n"] == width)
    named = occurs.select("doc_id", "row", "n", "win").distinct().join(own.select("n", F.concat("win", F.lit("")).alias("win"), "item"), ["n", "win"])
    named = named.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("row").alias("s_row"), covered.cast("long").alias("hit"), full.alias("full"))
    named = named.select(F.col("doc_id").alias("i_id"), F.col("row").alias("i_row"), "items")
    out = rows.select("doc_id", "row", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = out.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("row") == F.col("s_row")), "left")
    out = out.join(named, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("row") == F.col("i_row")), "left")
    out = out.select("doc_id", "row", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("full", F.lit(False)).alias("full"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, whole as they were, without the rows in which a whole window of width words occurs, however long they are, and
    without those that windows of shorter items alone contaminate.

    Null and empty texts, repeated rows and null ids stay; rows that share a doc_id are judged each by its own text. Other
    columns may have any name. An empty benchmark leaves docs as they are.
    """
    bad = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("full OR contaminated").select(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row"))
    rows = packed(docs, id_col, text_col)
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("row") == F.col("bad_row")), "left_anti").select("doc.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), s AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM s
), sizes AS (
  SELECT DISTINCT n FROM wins
), starts AS (
  SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS s FROM d, sizes
), occurs AS (
  SELECT doc_id, s, starts.n, item_id FROM starts JOIN wins ON wins.n = starts.n AND wins.win = array_to_string(w[s:s + starts.n - 1], ' ')
), hit AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(s, s + n)))))::BIGINT AS n_hit, list_sort(list(DISTINCT item_id)) AS items FROM occurs GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id)
"""
