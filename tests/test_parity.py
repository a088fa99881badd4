"""Every registered query of the catalogue against its SQL."""

import os

import duckdb
import pytest

from tidewell.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = sql.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(map(tuple, got.collect()), got.columns) == canonical(want.fetchall(), want.columns)


def test_entry(spark, sf_dir):
    assert registry.entry(spark, sf_dir).count() > 0
