"""Every core query that has SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from slatewing.plans import registry

SQL = registry.sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(df):
    def one(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>"):
            return "~"
        return f"{v:.6g}" if isinstance(v, float) or hasattr(v, "dtype") else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


def test_every_query_with_sql_exists():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    ours = registry.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)
