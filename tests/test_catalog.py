"""Every registered query of the selection and evaluation operators against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from framesift import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for file in os.listdir(SF):
        c.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return c


def rows_of(df):
    cols = sorted(df.columns)

    def cell(v):
        if v is None or (not isinstance(v, list) and pd.isna(v)):
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, float) else (int(v) if hasattr(v, "item") and not isinstance(v, bool) else v)

    return cols, sorted((tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, duck, name):
    assert rows_of(catalog.queries()[name](spark, SF).toPandas()) == rows_of(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
