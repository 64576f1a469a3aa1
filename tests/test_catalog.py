"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from tapewright import catalog, catalog_sql

SF = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "orders", "customer")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


SLOW = {"wfa_matrix", "walk_forward", "best_grid_cell", "grid_overfit"}  # the grid is in grid_search


@pytest.mark.parametrize("name", sorted(set(catalog_sql.ORACLES) - SLOW))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog_sql.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:  # one type of number and of time on both sides
        if got[c].dtype != want[c].dtype:
            want[c] = want[c].astype(got[c].dtype) if got[c].dtype != object else want[c].map(lambda x: x.date() if hasattr(x, "date") else x)
    assert rows_of(got) == rows_of(want)


def test_every_oracle_has_a_query():
    assert set(catalog_sql.ORACLES) <= set(catalog.QUERIES)
