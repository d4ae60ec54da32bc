"""The queries that SQL can express, against DuckDB over the same tables."""

from __future__ import annotations

import duckdb
import pytest

from dossier.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert len(at) == len(cur.description)
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
