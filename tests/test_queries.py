"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def fix(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        # pandas holds a nullable integer column as float or as Int64, depending on where it comes from
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted((tuple(fix(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).count() == 25
