"""Line dedup: lines that many documents share stay in one document alone.

Lines are exploded, normalised and hashed; distinct documents are counted for each hash; the lines over the threshold
are dropped by position and the rest of each document is put together again. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, apart_binary, ascii_lower, document_rows, table, text_key


def _without(lines: Column, gone: Column) -> Column:
    """lines without those at the sorted positions gone (from 0), in time linear in both."""
    n = F.size(gone)
    parts = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.slice(
            lines,
            F.when(k > 0, F.get(gone, k - 1) + 2).otherwise(1),
            F.coalesce(F.get(gone, k), F.size(lines)) - F.when(k > 0, F.get(gone, k - 1) + 1).otherwise(0),
        ),
    )
    return F.when(gone.isNull(), lines).otherwise(F.flatten(parts))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, whole: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, text (the lines that stay), n_lines, n_dropped; if whole is set also doc, the row of docs.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least min_chars code points in at
    least min_docs documents lose all their lines except in the largest doc_id that holds them; there every line stays.

    A null or empty text is one empty line, which is too short to be dropped, and its text comes back empty. Rows that
    share a doc_id count as one document; a null doc_id is one document, below all others. Repeated rows all come back.
    Other columns are ignored. An empty table gives an empty result.

    Cost: three scans; keys move as 16-byte hashes, counted map-side first, so a line that every document holds reaches
    a reducer as one row a task; the join back to that key is one Spark can split. Texts move once, by document.
    """
    rows = document_rows(docs, id_col, text_col).withColumn("lines", F.split("text", "\n", -1))
    stripped = F.transform("lines", lambda x: F.btrim(x, F.lit(BLANKS)))
    keys = F.transform(stripped, lambda x: F.when(F.char_length(x) >= min_chars, F.md5(ascii_lower(x).cast("binary"))))
    lines = (
        rows.select("doc_id", text_key(F.col("text")).alias("row"), F.posexplode(keys).alias("pos", "key"))
        .where(F.col("key").isNotNull())
        .withColumn("key", F.unhex("key"))
    )
    common = (
        lines.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    )
    gone = (
        lines.join(common.select(apart_binary(F.col("key")).alias("key"), "keeper"), "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
        .select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "gone")
    )
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row).withColumn("row", text_key(F.col("text")))
    joined = kept.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    lines = F.split("text", "\n", -1)
    return joined.select(
        "doc_id",
        F.array_join(_without(lines, F.col("gone")), "\n").alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        *(["doc"] if whole else []),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, whole as they were but for the lines that line_dedup() drops. A null text is an empty one."""
    out = line_dedup(docs, id_col, text_col, whole=True, **options)
    return out.select(*[F.col("text" if c == text_col else f"doc.`{c}`").alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
