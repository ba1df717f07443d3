"""Every query of the core beside its SQL on the smallest tables; those without SQL must give rows of a stable schema."""

from pathlib import Path

import duckdb
import pytest

from cuelake.plans import registry
from tools.compare import cell

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    columns = sorted(df.columns)
    mine = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert mine or name in {"c08_logistic"}
        return
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    assert sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in res.fetchall()), key=repr) == mine


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 200
