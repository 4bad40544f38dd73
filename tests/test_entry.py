import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, float) else str(value)


def rows(df):
    df = df[sorted(df.columns)]
    for column in df.columns:
        if str(df[column].dtype).startswith("datetime"):
            df = df.assign(**{column: df[column].astype("datetime64[us]")})
    return sorted((tuple(map(normal, row)) for row in df.itertuples(index=False)), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_has_an_oracle():
    extra = set() if entry.llm is None else {*entry.llm.queries(), "pipeline"}
    assert set(entry.oracle_sql()) - extra == set(entry.queries()) - extra


# One query of each family; the others go through the same operators as the tests of their modules.
SAMPLE = (
    "roundtrip_csv_text", "datetime_restore", "range_partition", "guarded_read", "view_chain", "table_references",
    "rewrite_references", "rewrite_table_names", "restore_waves", "blocked_dependents", "materialized_refresh",
    "tag_struct", "script_insert", "check_suite", "changed_content",
)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_duckdb(spark, duck, name):
    found = entry.queries()[name](spark, SF_DIR).toPandas()
    expected = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
