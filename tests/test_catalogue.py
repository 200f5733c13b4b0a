"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
import checking

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(small_dir):
    return checking.connect(small_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_answer_as_sql(spark, duck, small_dir, name):
    columns, rows = checking.spark_rows(QUERIES[name](spark, small_dir))
    sql_columns, sql_rows = checking.duck_rows(duck, ORACLES[name])
    assert columns == sql_columns
    assert rows == sql_rows
    # On the smallest tables nearly every nation has a single supplier.
    assert rows or name == "cluster_members"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_an_answer(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_flagship(spark):
    assert contract.entry(spark).columns == ["user_id", "ts", "event_id", "avg"]
