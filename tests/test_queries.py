"""Every query of the library's own catalog: against its oracle where there is one, else that it runs."""

import pytest

from cambium import catalog
from tests.oracle import expected, got


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_oracle(spark, sf, name):
    assert got(catalog.QUERIES[name](spark, sf)) == expected(catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_the_same_twice(spark, sf, name):
    """Queries that SQL can't say: rows are there, and the same with other partitions."""
    own = got(catalog.QUERIES[name](spark, sf))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert own[1] and got(catalog.QUERIES[name](spark, sf)) == own
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["duplicate_summary", "leakage_groups", "one_per_group", "balanced_round_robin", "fixed_batches"])
def test_does_not_depend_on_partitions(spark, sf, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = got(catalog.QUERIES[name](spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert got(catalog.QUERIES[name](spark, sf)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
