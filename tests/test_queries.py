"""Every telemetry query against its SQL, and the entry points."""

import pytest

from matchlake.plans import telemetry
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(telemetry.QUERIES))
def test_query(spark, data, name):
    names, rows = spark_rows(telemetry.QUERIES[name](spark, data))
    assert rows
    if name in telemetry.ORACLES:
        assert (names, rows) == duck_rows(telemetry.ORACLES[name], data)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
