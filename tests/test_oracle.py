"""Every registered query with SQL against DuckDB on the given tables."""

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(queries()[name](spark, sf_dir), con, SQL[name]) == ""


def test_comparison_sees_differences(spark, sf_dir, con):
    wrong = SQL["daily_payments"].replace("count(*)", "count(*) + 1")
    assert compare(queries()["daily_payments"](spark, sf_dir), con, wrong) != ""


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(queries())


def test_flagship_has_all_buckets(spark):
    got = {r["bucket"]: r["user_count"] for r in entry(spark).collect()}
    assert list(got) and set(got) == {"0", "1-3", "4-10", "11-50", "51+"}
    assert got["51+"] == 0 and sum(got.values()) > 0
