"""The operators' queries against their SQL, over the smallest tables."""

import os

import duckdb
import pytest

from strandjoin.llm.oracles import ORACLES
from strandjoin.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(str(r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
