"""Every registered query against its SQL, at the smallest scale."""

import pytest
from oracle_check import difference, entry

SF_DIR = "/root/testdata/sf0.001"


#: Queries on training text have their own tests.
OURS = [q for q in entry.queries() if q != "pipeline" and not q.startswith("op")]


def test_every_query_has_sql():
    assert set(OURS) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OURS)
def test_query(spark, name):
    assert difference(spark, name, SF_DIR) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
