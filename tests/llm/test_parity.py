"""SQL twins of the operators, on the given tables."""

import duckdb
import pytest

pytest.importorskip("tillroll.llm.queries")
from tillroll.llm import queries  # noqa: E402
from tools.oracle_check import TABLES, canon  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_parity(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.ORACLES[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([c[0] for c in rel.description], rel.fetchall())
