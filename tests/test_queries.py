"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import pytest

from tessera.plans import registry
from tests.compare import same

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, tables, name):
    same(QUERIES[name], ORACLE[name], spark, tables)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, tables, name):
    assert QUERIES[name](spark, tables).count() >= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
