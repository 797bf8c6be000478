"""The corpus queries that SQL can express against that SQL, on the smallest tables."""

import duckdb
import pytest

from failsig.llm.oracle import ORACLE
from failsig.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    expected = want.df()[columns].astype(str).sort_values(columns).values.tolist()
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert df.toPandas()[columns].astype(str).sort_values(columns).values.tolist() == expected
