"""Hand-computed results on the golden rows of FIXTURES.md section 3."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from conftest import AS_OF, day

from seatledger.operators import history as H
from seatledger.operators import lists as L
from seatledger.operators import reports as R


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_summary(golden):
    s = one(R.summary(golden, AS_OF))
    assert s["total_platforms"] == 2
    assert s["total_accounts"] == 3
    assert s["total_profiles"] == 5  # 102 is soft-deleted
    assert s["active_clients"] == 4  # 103 has no client
    assert s["total_revenue"] == D("33.49")  # 20.49 profiles (deleted too) + 13.00 profile renewals
    assert s["total_costs"] == D("22.50")  # 14.50 accounts + 8.00 account renewal
    assert s["total_profit"] == D("10.99")
    assert s["expired_profiles"] == 1  # 100 today counts; 102 deleted
    assert s["expiring_soon_profiles"] == 2  # 101, 103 (upper edge); 104 just outside
    assert s["expired_accounts"] == 1 and s["expiring_soon_accounts"] == 1
    assert s["expiring_soon_total"] == 3


def test_platform_report(golden):
    rows = {r["id"]: r.asDict() for r in R.platform_report(golden).collect()}
    a, b = rows[1], rows[2]
    assert a["total_cost"] == D("22.50")
    assert a["total_revenue"] == D("26.49")  # renewal 4 names platform 9, which is gone
    assert a["profit"] == D("3.99")
    assert a["account_count"] == 3 and a["profile_count"] == 5
    assert (b["account_count"], b["profile_count"], b["total_cost"], b["total_revenue"], b["profit"]) == (
        0,
        0,
        D("0.00"),
        D("0.00"),
        D("0.00"),
    )


def test_summary_and_report_differ_by_deleted_platform(golden):
    s = one(R.summary(golden, AS_OF))
    total = sum(r["total_revenue"] for r in R.platform_report(golden).collect())
    assert s["total_revenue"] - total == D("7.00")  # T8: renewal of platform 9


def test_platform_report_total(golden):
    rows = R.platform_report_total(golden).collect()
    tot = [r for r in rows if r["is_total"]]
    assert len(tot) == 1 and tot[0]["profit"] == D("3.99") and tot[0]["account_count"] == 3


def test_expiry_stats_join_rows_and_distinct(golden):
    fan = {r["id"]: r.asDict() for r in R.platform_expiry_stats(golden, AS_OF).collect()}[1]
    assert (fan["expired_accounts"], fan["expiring_soon_accounts"]) == (3, 3)
    assert (fan["expired_profiles"], fan["expiring_soon_profiles"]) == (2, 2)  # deleted 102 counts here
    true = {r["id"]: r.asDict() for r in R.platform_expiry_stats(golden, AS_OF, distinct=True).collect()}[1]
    assert (true["expired_accounts"], true["expiring_soon_accounts"]) == (1, 1)


def test_platform_list_counts_deleted_profiles(golden):
    rows = {r["id"]: r.asDict() for r in R.platform_list(golden, AS_OF).collect()}
    assert rows[1]["profile_count"] == 6 and rows[1]["account_count"] == 3
    assert rows[2]["profile_count"] == 0 and rows[2]["expired_accounts"] == 0
    assert R.platform_detail(golden, 77, AS_OF).count() == 0


def test_platform_alerts(golden):
    rows = {(r["platform_id"], r["kind"]): r["text"] for r in R.platform_alerts(golden, AS_OF).collect()}
    assert rows[(1, "expired_accounts")] == "🔴 3 cuenta(s) vencida(s)"
    assert rows[(1, "expiring_soon_profiles")] == "🟡 2 perfil(es) por vencer"
    assert not any(p == 2 for p, _ in rows)


def test_expiry_reports(golden):
    soon = R.expiring_soon(golden, AS_OF).collect()
    assert sorted((r["type"], r["id"]) for r in soon) == [("account", 12), ("profile", 101), ("profile", 103)]
    exp = R.expired(golden, AS_OF).collect()
    assert sorted((r["type"], r["id"]) for r in exp) == [("account", 10), ("profile", 100)]
    within = R.expiring_within(golden, AS_OF, "0").collect()  # '0' means 7
    assert sorted((r["type"], r["id"]) for r in within) == [
        ("account", 10),
        ("account", 12),
        ("profile", 100),
        ("profile", 101),
        ("profile", 103),
    ]
    counts = {r["type"]: r["n"] for r in R.expiring_within_counts(golden, AS_OF, 8).collect()}
    assert counts == {"account": 2, "profile": 4}


def test_account_list_revenue(golden):
    rows = {r["id"]: r.asDict() for r in L.account_list(golden, 1).collect()}
    # active 3.00 + 3.50, plus profile renewals 1 and 2 of account 10
    assert rows[10]["total_revenue"] == D("12.50") and rows[10]["profile_count"] == 2
    assert rows[11]["total_revenue"] == D("0.00") and rows[11]["profile_count"] == 0
    d = one(L.account_detail(golden, 12))
    assert d["max_profiles"] == 2 and d["profile_count"] == 3 and d["platform_name"] == "Alpha"


def test_profile_lists(golden):
    assert {r["id"] for r in L.profile_list(golden, 10).collect()} == {100, 101}
    assert L.profile_detail(golden, 102).count() == 0
    assert one(L.profile_detail(golden, 105))["account_email"] == "a12@x"


def test_history_bounds_and_fallback(golden):
    rows = H.renewal_history(golden, None, "1999-12-31").collect()
    assert len(rows) == 3  # 23:59:59 in, 23:59:59.5 out, null date out
    full = H.renewal_history(golden, limit=10).collect()
    assert full[0]["created_at"] is None  # null sorts first, newest first
    r5 = full[0].asDict()
    assert r5["client_name"] == ""  # live blank beats the snapshot
    assert r5["platform_name"] == "Alpha"
    gone = [r for r in full if r["profile_id"] == 999][0]
    assert (gone["profile_name"], gone["platform_name"], gone["account_email"]) == ("OldP999", "Old 9", "old99@x")
    tot = one(H.renewal_history_total(golden, limit=2))
    assert tot["count"] == 2 and tot["total_revenue"] == D("3.00")
    assert H.renewal_history(golden, limit=0).count() == 0


def test_series(golden):
    m = {r["month"]: r.asDict() for r in H.monthly(golden).collect()}
    assert m[None]["renewal_count"] == 1 and m["1999-12"]["revenue"] == D("14.00")
    d = H.renewals_daily(golden).collect()
    assert all(r["renewal_revenue"] > 0 for r in d)
    assert {r["date"] for r in H.sales_daily(golden).collect()} == {dt.date(1999, 6, 1)}
    by = {(r["month"], r["renewal_type"]): r["revenue"] for r in H.monthly_by_type(golden).collect()}
    assert by[("1999-12", "account")] == D("8.00") and by[("1999-12", "profile")] == D("6.00")


def test_day_helper():
    assert day(7) == dt.date(2000, 1, 8)
