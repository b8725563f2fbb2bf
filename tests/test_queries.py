"""Every query with SQL of its own agrees with it on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lexspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            x, y = a[c].astype(float), b[c].astype(float)
            assert (((x - y).abs() < 1e-6) | (x.isna() & y.isna())).all(), c
        elif "datetime" in f"{a[c].dtype}{b[c].dtype}":
            assert (pd.to_datetime(a[c]).astype("datetime64[us]") == pd.to_datetime(b[c]).astype("datetime64[us]")).all(), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["ngram", "n", "score", "everyday_share"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
