import pytest

import __spark_entry__ as entry
from plyforge.plans import oracle, queries
from tests.compare import ROOT, database, same


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    same(queries.queries()[name](spark, ROOT), oracle.oracle_sql()[name], db)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries.queries()[name](spark, ROOT).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["bucket", "n_plies", "n_errors", "n_blunders", "rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
