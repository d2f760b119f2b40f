"""Queries that SQL can express on whole tables, against their DuckDB text."""
import duckdb
import pytest

from reviewlake.llm.queries import ORACLES, QUERIES

from .helpers import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(res.fetchall(), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
