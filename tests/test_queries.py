"""Every query against its SQL twin."""

import os

import pytest
from oracle import connect, difference

import __spark_entry__ as entry
from tablescope.operators.profile import profile_columns
from tablescope.plans.tables import read_table

SF = os.environ.get("TABLESCOPE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    if name in SQL:
        assert difference(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 63


def test_approximate_counts_are_close(spark, duck):
    approx = profile_columns({"lineitem": read_table(spark, SF, "lineitem")}, approx=True).collect()
    for r in approx:
        exact = duck.sql(f"SELECT count(DISTINCT {r['column']}) FROM lineitem").fetchall()[0][0]
        assert abs(r["distinct_values"] - exact) <= max(2, 0.15 * exact)
