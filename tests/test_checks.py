"""Every registered query against its SQL on the given tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(smallest):
    return connect(smallest)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(name, spark, smallest, con):
    frame = QUERIES[name](spark, smallest)
    if name in CHECKS:
        assert difference(frame, con, CHECKS[name]) is None
    else:
        assert frame.count() > 0


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert [r.total_runs for r in rows] == sorted((r.total_runs for r in rows), reverse=True)
