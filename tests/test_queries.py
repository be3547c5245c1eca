"""Each query of the engine's own operators against its SQL in DuckDB, at the smallest scale."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from brindle.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = db.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    expected = Counter(plain(r) for r in found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert Counter(plain(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == expected


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_returnflag", "l_linestatus", "n_rows", "revenue_cents"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
