import __spark_entry__ as entry
from sori.plans import registry as plans


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
