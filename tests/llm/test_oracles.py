"""Registered queries with SQL give the rows of their SQL; all give one row per input row."""

import duckdb
import pytest

from boxlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in rel.description]
    exp = sorted((tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in rel.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == exp and got
