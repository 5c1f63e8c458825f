"""Distinct counts from bitmaps: against plain sets, merged, under skew, and their plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from seatledger.operators import distinct as U
from seatledger.sources.bindings import bind_tables
from seatledger.sources.tables import stage

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return bind_tables(spark, SF)


def counted(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)


def test_stored_and_added_bitmaps_give_the_whole(tables):
    log = tables.renewals
    half = F.pmod(F.xxhash64("account_id", "created_at"), F.lit(2)) == 0
    old, new = (stage(U.renewal_bitmaps(tables.with_(renewals=log.where(p))), "bitmaps") for p in (half, ~half))
    whole = stage(U.renewal_bitmaps(tables), "bitmaps")
    both = old.unionByName(new)
    assert counted(U.renewed_monthly(both)) == counted(U.renewed_monthly(whole))
    assert counted(U.renewed_platforms(both, "1998-01", "1999-12")) == counted(U.renewed_platforms(whole, "1998-01", "1999-12"))
    got = U.renewed_platforms(whole, "0000-00", "9999-99").where("is_total").first()
    seen = log.where("created_at IS NOT NULL").agg(F.count_distinct("account_id"), F.count_distinct("profile_id")).first()
    assert (got["accounts"], got["profiles"]) == tuple(seen)


def test_against_sets_with_nulls_far_ids_and_a_hot_id(spark):
    rows = [(k % 3 if k % 7 else None, i, i if i and i % 2 else None) for k, i in enumerate([1, 32768, 32769, 65536, 10**15, None, 0, -5, -32768] * 20)]
    rows += [(1, 77, None)] * 5000  # a third and more of all rows
    frame = spark.createDataFrame(rows, "g int, a long, b long")
    bits = U.id_bitmaps(frame, {"g": F.col("g")}, {"a": F.col("a"), "b": F.col("b")})
    got = {r["g"]: (r["a"], r["b"]) for r in U.distinct_counts(bits, ["g"], ("a", "b")).collect()}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        assert got[g] == tuple(len({r[c] for r in mine if r[c] is not None}) for c in (1, 2))
    total = U.distinct_counts(bits, [], ("a", "b")).first()
    assert tuple(total) == tuple(len({r[c] for r in rows if r[c] is not None}) for c in (1, 2))


def test_empty(tables):
    none = U.renewal_bitmaps(tables.with_(renewals=tables.renewals.limit(0)))
    assert U.renewed_monthly(none).collect() == []
    assert [tuple(r) for r in U.renewed_platforms(none, "1998-01", "1999-12").collect()] == [(None, 0, 0, 0, True)]


def test_plans(tables):
    built = plan(U.renewal_bitmaps(tables))
    assert built.count("lineitem.parquet") == 1 and "Expand" not in built and "Python" not in built
    # ids are made distinct on both sides of the first shuffle; bitmaps are built after the second, in no partial step before it
    last = re.split(r"Exchange hashpartitioning\(", built, maxsplit=1)
    assert "bitmap_construct_agg" in last[0] and "bitmap_construct_agg" not in last[1]
    later = plan(U.renewed_platforms(stage(U.renewal_bitmaps(tables), "bitmaps"), "1998-10", "1999-09"))
    assert "lineitem.parquet" not in later and "orders.parquet" not in later and "Expand" not in later
