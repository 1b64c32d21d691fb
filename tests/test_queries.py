"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from pixelweir.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(records, names, order):
    at = [names.index(c) for c in order]
    return sorted(repr(tuple(r[k] for k in at)) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    records = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert records
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    assert rows(records, got.columns, order) == rows(want.fetchall(), names, order)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
