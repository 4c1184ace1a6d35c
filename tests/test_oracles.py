"""Every registered query with a SQL twin gives the twin's rows."""

import pytest
from framelake.plans import registry

from conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, duck, same):
    same(registry.QUERIES[name](spark, SMALL), duck, registry.ORACLES[name])


def test_entry_has_rows_and_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 16
