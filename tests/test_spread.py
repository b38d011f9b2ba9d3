"""Queries that do much for each row of a small table run on all cores."""

import pytest

from attestra.plans import catalog
from attestra.sources.spread import LEAST_PARTS, spread


def test_spread_keeps_rows_and_says_the_number_of_parts(spark):
    rows = spread(spark.range(100).coalesce(1), "id")
    assert rows.rdd.getNumPartitions() == LEAST_PARTS and sorted(r.id for r in rows.collect()) == list(range(100))


@pytest.mark.parametrize("name", ["dated_replies", "reply_validation", "company_checks", "address_reasons", "address_checks", "identity_checks"])
def test_query_is_not_one_task(spark, sf, name):
    assert catalog.queries()[name](spark, sf).rdd.getNumPartitions() == LEAST_PARTS
