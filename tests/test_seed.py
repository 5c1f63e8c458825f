"""Default platforms of an empty table; over the given tables, seed_defaults is the query."""

from __future__ import annotations

from seatledger import catalog
from seatledger.sources.schema import seed_defaults

from conftest import AS_OF


def test_an_empty_table_gets_the_defaults(spark, golden):
    rows = seed_defaults(spark, golden.platforms.where("id < 0"), AS_OF).collect()
    assert len(rows) == 5 and len({r["name"] for r in rows}) == 5
    assert seed_defaults(spark, golden.platforms, AS_OF).count() == golden.platforms.count()


def test_no_query_over_a_table_that_is_always_empty():
    assert "seed_defaults" in catalog.QUERIES and "seed_defaults_empty" not in catalog.QUERIES
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
