"""The SQL of the text operators gives the same rows as their queries."""

import pandas as pd
import pytest

from quiremill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    have, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(have.columns) == sorted(want.columns)

    def rows(df: pd.DataFrame) -> list:
        return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(have) == rows(want)
