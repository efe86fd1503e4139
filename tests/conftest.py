import pathlib
import sys

import pytest

HERE = pathlib.Path(__file__).parent
sys.path[:0] = [str(HERE.parent), str(HERE)]

from session import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = spark_session()
    yield session
    session.stop()


@pytest.fixture
def shuffled_joins(spark):
    """No join may broadcast: every lookup is a shuffled join."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


@pytest.fixture
def frame(spark):
    """frame(schema name or DDL, *rows) -> DataFrame"""
    from tablescope.sources.schemas import SCHEMAS

    def make(schema, *rows):
        return spark.createDataFrame(list(rows), SCHEMAS.get(schema, schema))

    return make


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
