import pytest

import __spark_entry__ as contract
from tallyframe.plans.queries import QUERIES
from tests.compare import TESTDATA, database, difference

FOLDER = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    found = contract.queries()[name](spark, FOLDER).toPandas()
    assert len(found) > 0
    assert difference(found, db.sql(contract.oracle_sql()[name]).df()) is None


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_both_kinds_of_stratum_occur_in_the_certainty_query(spark):
    from tallyframe.plans.queries import _with_certainty_customers

    strata = _with_certainty_customers(spark, str(TESTDATA / "sf0.01"))
    assert strata.where("stratum < 0").count() > 0
