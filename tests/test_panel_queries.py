import pytest

from tidemark.plans.queries import QUERIES, SQL

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SF)


def test_entry_points_are_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
