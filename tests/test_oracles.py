"""Every registered query of the library against its SQL."""

import pytest

from tests.compare import same
from tidewake.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, duck, sf_dir):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
