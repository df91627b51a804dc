"""Each query against its SQL in a second engine, on whole tables."""

import pytest
from helpers import SF, duck_rows, rows_of

from foliant.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == duck_rows(duck, ORACLE_SQL[name])


def test_entry_points_import_and_run(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
