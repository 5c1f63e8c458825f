"""Stored versions: a change is published whole or not at all, and old files stay as they were."""

from __future__ import annotations

import glob
import os

import pytest

from seatledger import requests as Q
from seatledger.catalog import AS_OF
from seatledger.operators import changes as C
from seatledger.operators import outbox as N
from seatledger.operators import reports as R
from seatledger.sources import tables as S
from seatledger.sources.bindings import bind_tables
from seatledger.sources.schema import adopt

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {f: (os.path.getsize(f), os.path.getmtime(f)) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path)
    S.write_tables(bind_tables(spark, SF), path)
    return path, S.read_tables(spark, path)


def test_commit_then_reread(spark, stored):
    path, t = stored
    old = files(path)
    res = C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW)
    want = {n: rows(getattr(res.tables, n)) for n in S.NAMES}
    S.commit_changes(t, res, path)
    again = S.read_tables(spark, path)
    assert {n: rows(getattr(again, n)) for n in S.NAMES} == want
    new = files(path)
    assert all(new[f] == old[f] for f in old)
    # only the log rows of the change are written, not the log
    added = [f for f in new if f not in old and "/renewals/" in f]
    assert added and all("created_month=2000-01" in f for f in added)
    # and a second change upon the first
    res = C.insert_accounts(again, Q.insert_accounts_req(again), AS_OF)
    want = rows(res.tables.accounts)
    S.commit_changes(again, res, path)
    assert rows(S.read_tables(spark, path).accounts) == want


def test_a_failure_midway_leaves_the_old_version(spark, stored, monkeypatch):
    path, t = stored
    before = rows(t.renewals), rows(t.profiles)

    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(S, "_publish", stop)
    with pytest.raises(RuntimeError):
        S.commit_changes(t, C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW), path)
    now = S.read_tables(spark, path)
    assert (rows(now.renewals), rows(now.profiles)) == before


def test_tables_may_be_written_where_they_came_from(spark, stored):
    path, t = stored
    S.write_tables(C.soft_delete_profiles(t, Q.soft_delete_req(t)).tables, path)
    assert S.read_tables(spark, path).profiles.count() == t.profiles.count()
    S.write_tables(C.reset_data(S.read_tables(spark, path)), path)
    empty = S.read_tables(spark, path)
    assert empty.renewals.count() == empty.profiles.count() == 0 and empty.platforms.count() == 25


def test_the_original_tables_shape(spark):
    """created_at on platforms and accounts, provider_phone, and ids in the log."""
    from pyspark.sql import functions as F

    t = bind_tables(spark, SF)
    stamp = F.col("created_on").cast("timestamp_ntz").alias("created_at")
    raw = t.with_(
        platforms=t.platforms.select("id", "name", "icon", "color", "max_profiles", stamp),
        accounts=t.accounts.select("id", "platform_id", "email", "provider_name", F.lit("1").alias("provider_phone"), "cost", "expiry_date", stamp),
        renewals=t.renewals.select(F.monotonically_increasing_id().alias("id"), "*"),
    )
    a = adopt(raw)
    assert rows(R.platform_list(a, AS_OF)) == rows(R.platform_list(t, AS_OF))
    assert rows(R.platform_report(a)) == rows(R.platform_report(t))
    made = C.insert_accounts(a, Q.insert_accounts_req(a), AS_OF)
    assert made.tables.accounts.count() == a.accounts.count() + made.applied.count()
    assert {r["provider_phone"] for r in made.applied.collect()} == {""}
    kept = C.update_accounts(a, Q.update_accounts_req(a)).tables.accounts
    assert kept.columns == a.accounts.columns and kept.count() == a.accounts.count()
    for res in (C.renew_accounts(a, Q.renew_accounts_req(a), Q.NOW), C.renew_profiles(a, Q.renew_profiles_req(a), Q.NOW)):
        ids = [r["id"] for r in res.appended["renewals"].select("id").collect()]
        assert None not in ids and len(set(ids)) == len(ids)
        assert min(ids) > a.renewals.agg(F.max("id")).first()[0]


def test_update_without_optional_columns(spark, golden):
    req = spark.createDataFrame([(1, 100, "New", "Ana")], "seq bigint, id bigint, profile_name string, client_name string")
    row = {r["id"]: r for r in C.update_profiles(golden, req).tables.profiles.collect()}[100]
    assert (row["profile_name"], row["client_whatsapp"], row["expiry_date"]) == ("New", "", None)
    req = spark.createDataFrame([(1, 1, "New")], "seq bigint, id int, name string")
    row = {r["id"]: r for r in C.update_platforms(golden, req).tables.platforms.collect()}[1]
    assert (row["name"], row["icon"], row["max_profiles"]) == ("New", "📺", 5)


def test_deletes_keep_the_column_order(spark, golden):
    req = spark.createDataFrame([(1, 1)], "seq bigint, id bigint")
    for res in (C.delete_accounts(golden, req), C.delete_platforms(golden, req)):
        for n in S.NAMES:
            assert getattr(res.tables, n).columns == getattr(golden, n).columns


def test_notify_flag(spark, golden):
    import datetime as dt

    req = spark.createDataFrame(
        [(1, 104, dt.date(2000, 3, 1), False), (2, 100, dt.date(2000, 3, 1), None), (3, 101, dt.date(2000, 3, 1), True)],
        "seq bigint, profile_id bigint, new_expiry_date date, notify boolean",
    )
    res = C.renew_profiles(golden, req, Q.NOW)
    out = N.renewal_outbox(res.tables, res.applied, req)
    assert sorted(r["seq"] for r in out.collect()) == [2, 3]
    assert "Join" not in N.renewal_outbox(res.tables, res.applied)._jdf.queryExecution().optimizedPlan().toString()


def test_a_small_batch_does_not_shuffle_the_table(spark, tmp_path):
    """Two requests against a table too big to broadcast: no exchange over the table."""
    S.write_tables(bind_tables(spark, SF), str(tmp_path))
    t = S.read_tables(spark, str(tmp_path))
    live = t.profiles.where("is_active").first()["id"]
    req = spark.createDataFrame([(1, live, "A", "B"), (2, 10**9, "A", "B")], "seq bigint, id bigint, profile_name string, client_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        res = C.update_profiles(t, req)
        for df in (res.applied, res.rejected, res.tables.profiles):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            scan_at = [i for i, line in enumerate(plan.split("\n")) if "FileScan parquet" in line]
            lines = plan.split("\n")
            for i in scan_at:  # what stands above a scan of the table, up to its first join, is no exchange
                above = next((line for line in reversed(lines[:i]) if "Join" in line or "Exchange" in line), "")
                assert "BroadcastHashJoin" in above, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_carry_rows_of_sparse_requests(spark):
    """Numbers far apart: ranges of ranges leave few rows for the last window."""
    from seatledger.plans.sequence import bucketed

    df = spark.range(20_000).selectExpr("id * 5000 AS seq")
    twice = bucketed(bucketed(df, "seq", 4096, "near"), "near", 4096, "far")
    assert twice.select("far").distinct().count() <= 6
    assert twice.select("near", "far").distinct().groupBy("far").count().agg({"count": "max"}).first()[0] <= 4096


def renamed(spark, t, word):
    req = t.platforms.selectExpr("cast(id as bigint) as seq", "id", f"concat(name, ' {word}') as name")
    return C.update_platforms(t, req)


def test_an_old_base_is_refused(spark, stored):
    """Two changes made from one version: the second would undo the first."""
    path, t = stored
    S.commit_changes(t, renamed(spark, t, "first"), path)
    with pytest.raises(S.StaleVersion):
        S.commit_changes(t, renamed(spark, t, "second"), path)
    now = S.read_tables(spark, path)
    assert {r["name"].split()[-1] for r in now.platforms.collect()} == {"first"} and now.version == 2
    S.commit_changes(now, renamed(spark, now, "second"), path)
    assert {tuple(r["name"].split()[-2:]) for r in S.read_tables(spark, path).platforms.collect()} == {("first", "second")}
    with pytest.raises(S.StaleVersion):
        S.commit_changes(bind_tables(spark, SF), renamed(spark, now, "unread"), path)  # tables that were never read from the path


def test_two_writers_cannot_publish_one_version(spark, stored, monkeypatch):
    """Both look before either publishes."""
    path, t = stored
    seen = S._newest(spark, path)
    monkeypatch.setattr(S, "_newest", lambda *_: seen)
    S.commit_changes(t, renamed(spark, t, "one"), path)
    with pytest.raises(S.StaleVersion):
        S.commit_changes(t, renamed(spark, t, "two"), path)
    monkeypatch.undo()
    names = [r["name"] for r in S.read_tables(spark, path).platforms.collect()]
    assert len(names) == 25 and all(n.endswith(" one") for n in names)
    assert not [f for f in os.listdir(f"{path}/versions") if f.endswith(".json") and f > "000000000002.json"]


def test_a_reader_reads_one_version_file(spark, stored):
    """However many versions there are, and whatever a lost writer left behind."""
    path, t = stored
    for k in range(3):
        S.write_tables(S.read_tables(spark, path), path)
    (open(f"{path}/versions/.left", "w")).close()
    assert S.read_tables(spark, path).version == 4
    assert sorted(f for f in os.listdir(f"{path}/versions") if f.endswith(".json")) == [f"{k:012d}.json" for k in range(1, 5)]
