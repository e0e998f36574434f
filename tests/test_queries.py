"""Every query against its SQL on the smallest tables, and the contract of the entry module."""

import pytest

import __spark_entry__
from quillmark.plans import catalog
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    same(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["keyword_df", "claim_conflict", "segment_islands", "rate_limit", "near_dup_dice"])
def test_rows_do_not_depend_on_partitions(spark, sf, name):
    def rows(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        return sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()))

    try:
        assert rows("1") == rows("8")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
