"""The operators that SQL can express, against it, whole tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from brindle.llm.queries import ORACLES, QUERIES


def same(spark, name, folder):
    df = QUERIES[name](spark, folder)
    db = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f if f.is_file() else f / '*.parquet'}'")
    found = db.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    expected = Counter(found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert Counter(map(tuple, df.select(*columns).collect())) == expected


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, folder, name):
    same(spark, name, folder)


#: The columns that each contract names, with their types; others may follow.
SCHEMAS = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_and_schemas(spark, none, name):
    df = QUERIES[name](spark, none)
    kinds = dict(df.dtypes)
    assert df.collect() == []
    assert {c: kinds.get(c) for c in (x.split()[0] for x in SCHEMAS[name].split(", "))} == dict(x.split() for x in SCHEMAS[name].split(", "))


def test_pipeline_of_an_empty_table(spark, none):
    assert corpus_pipeline.run(spark, none).collect() == []
