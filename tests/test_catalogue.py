"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__

FOLDER = Path(os.environ.get("WEFTLINE_TABLES", "/root/testdata/sf0.001"))
#: Queries that find nothing in tables of a thousandth.
EMPTY_AT_THE_SMALLEST = {"audit_by_resource"}
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in FOLDER.iterdir():
        inner = f"{path}/*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{inner}'")
    return connection


def normal(frame: pd.DataFrame) -> list[tuple]:
    def text(x) -> str:
        if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
            return "~"
        return (str(int(x)) if x == int(x) else f"{x:.6g}") if isinstance(x, float) else str(x)

    return sorted(tuple(text(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_and_sql(spark, duck, name):
    result = __spark_entry__.queries()[name](spark, str(FOLDER))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = result.toPandas()
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    assert len(got) or name in EMPTY_AT_THE_SMALLEST, "nothing was compared with nothing"


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """What SQL cannot say is compared with plain readings of it in the operators' own tests; here it has to give rows."""
    assert __spark_entry__.queries()[name](spark, str(FOLDER)).count() > 0


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    try:
        plan = __spark_entry__.queries()["run_filter_combined"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(tenant,harbor-grid)" in plan and "StringStartsWith(def_name,ledger)" in plan
    assert "document" not in plan  # only the columns that are named are read


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
