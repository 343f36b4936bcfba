import __spark_entry__ as entry
from lexiflow.plans import catalogue


def test_every_query_is_registered(spark):
    names = set(entry.queries())
    assert {f.__name__ for f in catalogue.QUERIES} <= names and set(entry.oracle_sql()) <= names
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_and_small_tables(spark):
    assert entry.entry(spark).limit(1).count() == 1
