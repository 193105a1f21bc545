"""Every query of the subpackage that has SQL, against it."""

import duckdb
import pytest

from corvane.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str)
    theirs = sorted((tuple(r) for r in want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()), key=str)
    assert mine == theirs
