"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from loomspark.plans import core_catalog
from tests.compare import DATA, check

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CATALOG = core_catalog()


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(spark, name):
    if name in CATALOG.sql:
        check(spark, name, CATALOG.queries[name], CATALOG.sql[name], SF)
    else:
        assert CATALOG.queries[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
