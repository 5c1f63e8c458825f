"""
property tests of the text helpers."""

from __future__ import annotations

import urllib.parse
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatledger import requests as Q
from seatledger.catalog import AS_OF
from seatledger.functions import text as X
from seatledger.operators import changes as C
from seatledger.operators import history as H
from seatledger.operators import reports as R
from seatledger.sources.bindings import bind_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return bind_tables(spark, SF)


def test_distinct_counts_never_exceed_join_row_counts(t):
    fan = {r["id"]: r for r in R.platform_expiry_stats(t, AS_OF).collect()}
    one = {r["id"]: r for r in R.platform_expiry_stats(t, AS_OF, distinct=True).collect()}
    for k in fan:
        assert one[k]["expired_accounts"] <= fan[k]["expired_accounts"]
        assert one[k]["expiring_soon_accounts"] <= fan[k]["expiring_soon_accounts"]


def test_report_plus_missing_platforms_equals_summary(t):
    s = R.summary(t, AS_OF).collect()[0]
    rep = R.platform_report(t).agg(F.sum("total_revenue"), F.sum("total_cost")).collect()[0]
    pl_ids = t.platforms.select(F.col("id").alias("platform_id"))
    gone = t.renewals.join(pl_ids, "platform_id", "left_anti")
    extra_rev = gone.where("renewal_type = 'profile'").agg(F.sum("sale_price")).collect()[0][0] or D(0)
    extra_cost = gone.where("renewal_type = 'account'").agg(F.sum("sale_price")).collect()[0][0] or D(0)
    # profiles whose account is gone count in the summary only (none here: bindings keep parents)
    assert rep[0] + extra_rev == s["total_revenue"]
    assert rep[1] + extra_cost == s["total_costs"]


def test_changes_conserve_rows(t):
    n = t.profiles.count()
    assert C.update_profiles(t, Q.update_profiles_req(t)).tables.profiles.count() == n
    assert C.soft_delete_profiles(t, Q.soft_delete_req(t)).tables.profiles.count() == n
    res = C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW)
    assert res.tables.profiles.count() == n
    assert res.tables.renewals.count() == t.renewals.count() + res.applied.count()
    req = Q.renew_profiles_req(t).count()
    assert res.applied.count() + res.rejected.count() == req


def test_renewal_then_history_shows_it(t):
    res = C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW)
    top = H.renewal_history(res.tables, "2000-01-01", "2000-01-01", 5).collect()
    assert len(top) == 5 and all(r["created_at"].isoformat() == "2000-01-01T12:00:00" for r in top)
    # the live labels are used: the profile still exists
    assert all(r["profile_name"].startswith("P") for r in top)


def test_delete_platforms_leaves_no_orphans(t):
    res = C.delete_platforms(t, Q.delete_platforms_req(t)).tables
    a = res.accounts.join(res.platforms.select(F.col("id").alias("platform_id")), "platform_id", "left_anti")
    p = res.profiles.join(res.accounts.select(F.col("id").alias("account_id")), "account_id", "left_anti")
    assert a.count() == 0 and p.count() == 0


def _es(x: D) -> str:
    neg = x < 0
    whole, frac = f"{abs(x):.2f}".split(".")
    if len(whole) >= 5:
        whole = f"{int(whole):,}".replace(",", ".")
    return "$" + ("-" if neg else "") + whole + "," + frac


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=2, allow_nan=False), min_size=1, max_size=40))
def test_money_text_property(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x decimal(12,2)")
    assert [r[0] for r in df.select(X.money_text("x")).collect()] == [_es(x) for x in xs]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=30), min_size=1, max_size=30))
def test_uri_component_property(spark, texts):
    texts = [s for s in texts if "\ud800" > s or True]
    clean = [s.encode("utf-8", "ignore").decode("utf-8") for s in texts]
    df = spark.createDataFrame([(s,) for s in clean], "s string")
    got = [r[0] for r in df.select(X.uri_component("s")).collect()]
    assert got == [urllib.parse.quote(s, safe="-_.!~*'()") for s in clean]


def test_money_totals_beyond_eighteen_digits(spark):
    """Totals over a whole business exceed 10^16; they must not overflow (ANSI)."""
    from seatledger.model import money, money_sum

    big = D("99999999.99")
    df = spark.createDataFrame([(big,)], "x decimal(10,2)")
    # 10^12 such prices, as a 100 TB log could hold
    tot = df.select(money(F.col("x") * F.lit(10**12).cast("decimal(13,0)")).alias("t"))
    assert tot.collect()[0]["t"] == big * 10**12
    s = df.select(money_sum("x").alias("s")).collect()[0]["s"]
    assert s == big
    txt = tot.select(X.money_text("t").alias("m")).collect()[0]["m"]
    assert txt.startswith("$99.999.999.990.000.000.000") and txt.endswith(",00")
