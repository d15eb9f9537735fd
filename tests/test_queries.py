import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("FACTSTORE_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(rows, order):
    def value(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, con, name):
    df = queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in oracle_sql():
        assert got
        return
    result = con.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = result.fetchall()
    assert (plain(got, [df.columns.index(c) for c in sorted(names)])
            == plain(want, [names.index(c) for c in sorted(names)]))


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
