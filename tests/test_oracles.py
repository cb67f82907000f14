"""Every query that has SQL gives the SQL's rows on the driver's tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in data), key=repr)


def same(a, b):
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    result = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    theirs = rows(names, result.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert len(mine) == len(theirs)
    wrong = [(a, b) for a, b in zip(mine, theirs) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"train_score"}))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
