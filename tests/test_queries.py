"""Every library query against its SQL, on the smallest tables."""

import pytest

from plumeline.queries import ORACLES, QUERIES

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same_rows(spark, QUERIES, ORACLES, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
