"""Queries that once ran on an id prefix read whole tables."""

import pytest

from lakeloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "table"), [("fn_math", "lineitem"), ("fn_trig", "lineitem"), ("fn_bits", "lineitem"), ("fn_json", "events")])
def test_every_row_is_projected(spark, name, table):
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize(("name", "customers", "orders"), [("join_inner", False, False), ("join_left", True, False), ("join_right", False, True), ("join_full", True, True)])
def test_joins_keep_unmatched_rows_of_whole_tables(spark, name, customers, orders):
    got = registry.queries()[name](spark, SF)
    found = spark.read.parquet(f"{SF}/orders.parquet")
    left = found.filter("o_custkey = 7").count()  # their key is null, so they match nothing
    assert left and got.filter("b is not null").count() == found.count() - (0 if orders else left)
    assert (got.filter("b is null").count() > 0) == customers and (got.filter("a is null").count() == left) == orders
    if customers:
        assert got.filter("a is not null").select("a").distinct().count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_cross_join_has_every_pair(spark):
    count = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    assert registry.queries()["join_cross"](spark, SF).count() == count("region") * count("nation")


def test_every_event_is_compacted(spark):
    want = spark.read.parquet(f"{SF}/events.parquet").filter("user_id >= 10").count()
    assert registry.queries()["lake_compaction"](spark, SF).count() == want
