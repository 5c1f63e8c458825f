"""Change batches: sequences, cascades, defaults, rejections, invariants."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D

from conftest import AS_OF, day
from pyspark.sql import Window
from pyspark.sql import functions as F

from seatledger.operators import changes as C
from seatledger.operators import outbox as N
from seatledger.operators import reports as R
from seatledger.plans.sequence import previous_in_key, rank_in_key

NOW = dt.datetime(2000, 1, 1, 9, 30)


def test_renew_sequence_chains_old_dates(spark, golden):
    """FIXTURES section 4: 101 renews at seq 1 and 2."""
    req = spark.createDataFrame(
        [(1, 101, day(31), D("4.00")), (2, 101, day(61), None), (3, 102, day(9), None), (4, 5555, day(9), None)],
        "seq bigint, profile_id bigint, new_expiry_date date, sale_price decimal(10,2)",
    )
    res = C.renew_profiles(golden, req, NOW)
    log = sorted(res.applied.collect(), key=lambda r: r["seq"])
    assert [(r["old_expiry_date"], r["new_expiry_date"]) for r in log] == [(day(1), day(31)), (day(31), day(61))]
    assert [r["sale_price"] for r in log] == [D("4.00"), D("0.00")]
    assert log[0]["platform_name"] == "Alpha" and log[0]["account_email"] == "a10@x"
    prof = {r["id"]: r for r in res.tables.profiles.collect()}
    assert prof[101]["expiry_date"] == day(61) and prof[101]["sale_price"] == D("3.50")
    assert sorted(r["seq"] for r in res.rejected.collect()) == [3, 4]  # deleted 102, missing 5555
    assert res.tables.renewals.count() == golden.renewals.count() + 2


def test_renew_price_default_option(spark, golden):
    req = spark.createDataFrame([(1, 101, day(31), None)], "seq bigint, profile_id bigint, new_expiry_date date, sale_price decimal(10,2)")
    row = C.renew_profiles(golden, req, NOW, price_default="profile").applied.collect()[0]
    assert row["sale_price"] == D("3.50")


def test_renew_accounts(spark, golden):
    req = spark.createDataFrame(
        [(5, 11, day(30), D("4.50")), (6, 11, day(60), None), (7, 42, day(1), None)],
        "seq bigint, account_id bigint, new_expiry_date date, renewal_cost decimal(10,2)",
    )
    res = C.renew_accounts(golden, req, NOW)
    log = sorted(res.applied.collect(), key=lambda r: r["seq"])
    assert [(r["old_expiry_date"], r["new_expiry_date"]) for r in log] == [(None, day(30)), (day(30), day(60))]
    assert all(r["renewal_type"] == "account" and r["profile_id"] is None and r["client_name"] == "" for r in log)
    assert [r["seq"] for r in res.rejected.collect()] == [7]
    s = R.summary(res.tables, AS_OF).collect()[0]
    assert s["total_costs"] == D("27.00")


def test_renewal_target_date(spark, golden):
    req = spark.createDataFrame([(1, 100, 30), (2, 104, 30), (3, 105, 0), (4, 102, 5)], "seq bigint, id bigint, days int")
    out = {r["seq"]: r for r in C.renewal_target_date(golden, req, AS_OF).collect()}
    assert out[1]["new_expiry_date"] == day(30)  # expired today: base is today
    assert out[2]["new_expiry_date"] == day(38)  # later of expiry and today
    assert out[3]["reason"] == "invalid_days" and out[4]["reason"] == "not_found"
    acc = C.renewal_target_date(golden, spark.createDataFrame([(1, 10, 3)], "seq bigint, id bigint, days int"), AS_OF, "account")
    assert acc.collect()[0]["new_expiry_date"] == day(3)


def test_inserts_defaults_and_ids(spark, golden):
    req = spark.createDataFrame(
        [(7, "Gamma", "", None, 0), (8, "", "x", "#1", 3), (9, "Delta", "D", "#2", 4)],
        "seq bigint, name string, icon string, color string, max_profiles int",
    )
    res = C.insert_platforms(golden, req, AS_OF)
    new = {r["name"]: r for r in res.applied.collect()}
    assert new["Gamma"]["icon"] == "📺" and new["Gamma"]["color"] == "#6c5ce7" and new["Gamma"]["max_profiles"] == 5
    assert new["Gamma"]["id"] == 3 and new["Delta"]["id"] == 5
    assert [r["reason"] for r in res.rejected.collect()] == ["missing_field"]
    ids = [r["id"] for r in res.tables.platforms.collect()]
    assert len(ids) == len(set(ids)) == 4


def test_insert_profiles_capacity(spark, golden):
    req = spark.createDataFrame(
        [(1, 11, "N1", "c", None), (2, 11, "N2", "c", None), (3, 11, "N3", "c", None), (4, 10, "N4", "c", None), (5, 77, "N5", "c", None)],
        "seq bigint, account_id bigint, profile_name string, client_name string, client_whatsapp string",
    )
    plain = C.insert_profiles(golden, req, NOW)
    assert plain.applied.count() == 4 and [r["reason"] for r in plain.rejected.collect()] == ["parent_not_found"]
    capped = C.insert_profiles(golden, req, NOW, enforce_capacity=True)
    # Alpha allows 2: account 11 has none active (two admitted), account 10 has two (full)
    assert sorted(r["profile_name"] for r in capped.applied.collect()) == ["N1", "N2"]
    assert sorted(r["reason"] for r in capped.rejected.collect()) == ["account_full", "account_full", "parent_not_found"]


def test_updates_last_write_wins(spark, golden):
    req = spark.createDataFrame(
        [(1, 10, "e1", "pw", "", D("0"), day(3)), (2, 10, "e2", "pw", "prov2", D("5"), None), (3, 10, "", "pw", "x", D("1"), None), (4, 99, "e", "pw", "", None, None)],
        "seq bigint, id bigint, email string, password string, provider_name string, cost decimal(10,2), expiry_date date",
    )
    res = C.update_accounts(golden, req)
    a = {r["id"]: r for r in res.tables.accounts.collect()}[10]
    assert (a["email"], a["provider_name"], a["cost"], a["expiry_date"]) == ("e2", "prov2", D("5.00"), None)
    assert sorted(r["reason"] for r in res.rejected.collect()) == ["missing_field", "not_found"]
    keep = {r["id"]: r for r in C.update_accounts(golden, req, keep_expiry_on_blank=True).tables.accounts.collect()}[10]
    assert keep["expiry_date"] == day(3)


def test_update_profile_only_active_and_merge(spark, golden):
    req = spark.createDataFrame(
        [(1, 102, "X", "Y", None, None, None), (2, 101, "P", "Q", None, None, None)],
        "seq bigint, id bigint, profile_name string, client_name string, client_whatsapp string, sale_price decimal(10,2), expiry_date date",
    )
    res = C.update_profiles(golden, req)
    p = {r["id"]: r for r in res.tables.profiles.collect()}
    assert p[101]["sale_price"] == D("0.00") and p[101]["expiry_date"] is None and p[101]["client_whatsapp"] == ""
    assert p[102]["profile_name"] == "P102"
    merged = {r["id"]: r for r in C.merge_profiles(golden, req).tables.profiles.collect()}
    assert merged[101]["sale_price"] == D("3.50") and merged[101]["client_name"] == "Q"
    assert merged[102]["profile_name"] == "X"  # merge does not require an active profile


def test_deletes_cascade(spark, golden):
    req = spark.createDataFrame([(1, 100), (2, 100), (3, 102)], "seq bigint, id bigint")
    res = C.soft_delete_profiles(golden, req)
    p = {r["id"]: r["is_active"] for r in res.tables.profiles.collect()}
    assert p[100] is False and sorted(r["seq"] for r in res.rejected.collect()) == [2, 3]
    acc = C.delete_accounts(golden, spark.createDataFrame([(1, 12), (2, 50)], "seq bigint, id bigint"))
    assert {r["id"] for r in acc.tables.profiles.collect()} == {100, 101, 102}
    assert acc.tables.renewals.count() == golden.renewals.count()
    pl = C.delete_platforms(golden, spark.createDataFrame([(1, 1)], "seq bigint, id bigint"))
    assert pl.tables.accounts.count() == 0 and pl.tables.profiles.count() == 0 and pl.tables.platforms.count() == 1
    # no orphans after a cascade
    t = acc.tables
    assert t.profiles.join(t.accounts.select(F.col("id").alias("account_id")), "account_id", "left_anti").count() == 0


def test_reset_then_summary_zero(golden):
    s = R.summary(C.reset_data(golden), AS_OF).collect()[0]
    assert s["total_platforms"] == 2 and s["total_accounts"] == 0 and s["total_revenue"] == D("0.00")


def test_renewal_outbox_message(spark, golden):
    req = spark.createDataFrame([(1, 104, day(38), None), (2, 103, day(30), None)], "seq bigint, profile_id bigint, new_expiry_date date, sale_price decimal(10,2)")
    res = C.renew_profiles(golden, req, NOW)
    out = N.renewal_outbox(res.tables, res.applied).collect()
    assert [r["profile_id"] for r in out] == [104]  # 103 has no phone
    msg = out[0]["message"]
    assert msg.startswith("*🔴ALPHA🔴*\n========================\n📧 *CORREO:* a12@x\n")
    assert "*PIN:* Sin PIN" in msg and "📅 *VENCE: 08 de febrero de 2000*" in msg
    assert out[0]["link"].startswith("https://wa.me/5413?text=")


def _random_requests(spark, n=3000, keys=5, seed=7):
    rnd = random.Random(seed)
    seqs = rnd.sample(range(1, 50 * n), n)
    rows = [(s, 1 if rnd.random() < 0.6 else rnd.randint(2, keys), rnd.randint(0, 10**6)) for s in seqs]
    return spark.createDataFrame(rows, "seq bigint, k bigint, v bigint")


def test_sequence_helpers_equal_plain_windows(spark):
    df = _random_requests(spark)
    w = Window.partitionBy("k").orderBy("seq")
    want = {(r["seq"]): (r["p"], r["n"]) for r in df.select("seq", F.lag("v").over(w).alias("p"), F.row_number().over(w).alias("n")).collect()}
    got_p = {r["seq"]: r["p"] for r in previous_in_key(df, "k", "seq", "v", "p", bucket=64).collect()}
    got_n = {r["seq"]: r["n"] for r in rank_in_key(df, "k", "seq", "n", bucket=64).collect()}
    assert got_p == {s: p for s, (p, _) in want.items()}
    assert got_n == {s: n for s, (_, n) in want.items()}


def test_renew_profile_whose_account_is_gone(spark, golden):
    """An active profile without its account is not found (inner joins of the
    original), also when the batch meets profiles before accounts."""
    orphaned = golden.with_(accounts=golden.accounts.where(F.col("id") != 10))
    req = spark.createDataFrame(
        [(1, 101, day(31), None), (2, 101, day(45), None)],
        "seq bigint, profile_id bigint, new_expiry_date date, sale_price decimal(10,2)",
    )
    res = C.renew_profiles(orphaned, req, NOW)
    assert res.applied.count() == 0
    assert sorted((r["seq"], r["reason"]) for r in res.rejected.collect()) == [(1, C.NOT_FOUND), (2, C.NOT_FOUND)]
    prof = {r["id"]: r for r in res.tables.profiles.collect()}
    assert prof[101]["expiry_date"] == day(1)  # unchanged
    assert N.renewal_outbox(res.tables, res.applied).count() == 0
