"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fixtures import SF_SMALL
from tools.oracle_check import TABLES, canon

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(ORACLES[name])
    o_cols, o_rows = canon([d[0] for d in rel.description], rel.fetchall())
    assert s_cols == o_cols
    assert s_rows == o_rows
