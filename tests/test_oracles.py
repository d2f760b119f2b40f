"""Every registered query against its DuckDB oracle on the smallest driver tables (the same check
the driver runs at sf0.01).  No query may be without an oracle or give no rows."""
import math
import os

import duckdb
import pytest

from reviewlake.plans.fixtures import BASE_TABLES
from reviewlake.plans.registry import load_all

from .conftest import SF_SMALL

REG = load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(REG))
def test_query(spark, con, key):
    e = REG[key]
    df = e.build(spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert e.oracle is not None, "every query has an oracle"
    assert rows, "an empty result proves nothing"
    res = con.execute(e.oracle)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, rows) == _rows(dcols, res.fetchall())


def test_entry(spark):
    import __spark_entry__ as ent

    df = ent.entry(spark)
    assert df.count() > 0
    assert set(ent.oracle_sql()) <= set(ent.queries())
