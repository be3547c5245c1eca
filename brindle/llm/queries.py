"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language, line_dedup, pii, quality, secrets, sharding, simhash, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.op1_secrets,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_language": language.op4_language,
    "op5_quality": quality.op5_quality,
    "op6_bpe": bpe.op6_bpe,
    "op7_sharding": sharding.op7_sharding,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_pii": pii.op10_pii,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}
