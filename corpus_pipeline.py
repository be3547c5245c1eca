"""From raw documents to token ids: a pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents, whatever others there are and whatever their names. Null ids are ids like any other, and an empty table stays empty. What a stage does with null, empty
and very long texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontaminate, line_dedup, quality, simhash
from brindle.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them, and repeated rows together."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one alone; n_chars, where it is there, follows the text. A null text becomes an empty one; all rows stay, repeated ones too."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the least id: by fingerprints as op3 links them, or five-word shingles with a similarity of 0.8. Null, empty
    and blank texts are one group, as are repeated rows."""
    return simhash.near_dedup(docs, similar=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which 13 words of a benchmark item occur in a row go, however long they are, and those that shorter items contaminate. Null and empty texts stay, as do
    repeated rows that are clean."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the checksum of the decoded ids, for each row; null and empty texts have no ids."""
    return bpe.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: Stages 1, 3 and 5 aren't expressible in SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what one leaves is written to the checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
