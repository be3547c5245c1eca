"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
#: Java's pattern for one run of characters that aren't in BLANKS.
BLANK_RUN = r"[\x20\x09-\x0D]+"
_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. lower() would change other letters too, so it serves only texts that are all ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where all executors are threads of this process, as in
    tests, one of our own serves if none is named; on a cluster that is an error, since executors can't see the driver's folders.

    Spark drops a checkpoint's files once nothing refers to it any more, unless the cluster has set that otherwise.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    own = sc._jsc.sc().conf()
    if not own.contains(_CLEAN):
        own.set(_CLEAN, "true")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df cut from its lineage: written to the checkpoint folder, which outlives executors, and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on Arrow batches to Python hold most bytes at most, or one row: a worker, of which an executor runs several, has few texts at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def text_key(text: Column) -> Column:
    """With the document's id this names a row: rows that agree in both are copies and get the same answer."""
    return F.xxhash64(text)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, a null text as an empty one; other columns can't clash with ours."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (a hash of the text) and doc, the whole row: none of its columns can clash with ours."""
    row = text_key(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def apart(c: Column) -> Column:
    """c, a long, as an expression Spark doesn't know a side to be dealt by already.

    Joined by it, that side is shuffled for the join itself, so adaptive execution may split a hot key of the other side.
    """
    return c.bitwiseXOR(F.lit(0).cast("long"))


def apart_binary(c: Column) -> Column:
    """The same for hashes of 16 bytes."""
    return F.substring(c, 1, 16)


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, even where f reads it inside other lambdas: the optimiser can't copy it there."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Rows up to which a table of counts or models, one row for each group, is broadcast.
SMALL = 20_000


def small(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df, to be joined by key, a long: broadcast if its number of rows is small, else dealt so that a hot key of the other side can be split."""
    return F.broadcast(df) if rows <= SMALL else df.withColumn(key, apart(F.col(key)))
