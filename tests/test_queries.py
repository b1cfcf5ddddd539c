"""Every graph query against its SQL, on the driver's tables where they are there."""

import os

import duckdb
import pytest

from codeloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    def cell(v):
        return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert got == canonical(want.fetchall(), columns)


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
