"""Every registered query against its SQL on DuckDB: names, types and exact rows."""

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return oracle.connect(folder)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    assert oracle.type_differences(df, duck, ORACLES[name]) == {}
    assert oracle.differences(oracle.spark_rows(df), oracle.duck_rows(duck, ORACLES[name])) == []


# Queries whose columns are chosen by the data.
BY_KIND = "column_kinds select_kind rate_all_dummy rate_all_discrete profile_levels profile_continuous".split()


@pytest.mark.parametrize("name", BY_KIND)
def test_columns_chosen_by_kind_at_a_smaller_scale(spark, name):
    small = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, small)
    assert oracle.differences(oracle.spark_rows(df), oracle.duck_rows(oracle.connect(small), ORACLES[name])) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "SK_ID_CURR" in df.columns
