"""Capacity with releases, against requests taken one by one."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seatledger.model import RENEWALS, Tables
from seatledger.operators import admission as A

NOW = dt.datetime(2000, 1, 1, 12)
REQUEST = "seq bigint, kind string, id bigint, account_id bigint, profile_name string, client_name string"


def one_by_one(cap: dict, rows: dict, requests: list) -> list:
    """rows: id -> [account, active]; outcomes (seq, kind, id, reason)."""
    low, top, out = min(r[0] for r in requests), max(rows, default=0), []
    for seq, kind, id_, account, name, client in sorted(requests):
        reason = None
        if kind == A.INSERT:
            id_ = top + seq - low + 1
            if not (account and name and client):
                reason = "missing_field"
            elif account not in cap:
                reason = "parent_not_found"
            elif cap[account] is not None and sum(a == account and on for a, on in rows.values()) >= cap[account]:
                reason = "account_full"
            else:
                rows[id_] = [account, True]
        elif kind == A.RELEASE:
            if id_ in rows and rows[id_][1]:
                rows[id_][1] = False
            else:
                reason = "not_found"
        else:
            reason = "unknown_kind"
        out.append((seq, kind, id_, reason))
    return out


@pytest.mark.parametrize("seed", [0, 2])
def test_one_by_one(spark, seed):
    draw = random.Random(seed)
    platforms = [(1, "a", "i", "c", 2, None), (2, "b", "i", "c", 4, None)]
    accounts = [(i, 1 + i % 3, "e", "p", 0, None, None) for i in range(10, 16)]  # some on a platform that is not there
    profiles = [(i, draw.randint(10, 15), "p", "c", "w", 0, None, draw.random() < 0.7, None) for i in range(100, 125)]
    make = spark.createDataFrame
    t = Tables(
        make(platforms, "id int, name string, icon string, color string, max_profiles int, created_on date"),
        make(accounts, "id long, platform_id int, email string, provider_name string, cost int, expiry_date date, created_on date").withColumn("cost", F.col("cost").cast("decimal(10,2)")),
        make(profiles, "id long, account_id long, profile_name string, client_name string, client_whatsapp string, sale_price int, expiry_date date, is_active boolean, created_at timestamp_ntz").withColumn(
            "sale_price", F.col("sale_price").cast("decimal(10,2)")
        ),
        make([], RENEWALS),
    )
    step, seq, requests = (1, 7, 5000)[seed], 50, []
    for k in range(250):
        if draw.random() < 0.55:
            requests.append((seq, A.INSERT, None, draw.randint(10, 16), draw.choice(["n"] * 9 + [""]), "c"))
        else:
            made = [124 + r[0] - 50 + 1 for r in requests if r[1] == A.INSERT]
            id_ = draw.choice(made) if made and draw.random() < 0.6 else draw.randint(100, 126)
            requests.append((seq, A.RELEASE if k % 50 else "other", id_, None, None, None))
        seq += draw.randint(1, step)
    rows = {r[0]: [r[1], r[7]] for r in profiles}
    cap = {a[0]: {1: 2, 2: 4}.get(a[1]) for a in accounts}
    want = one_by_one(cap, rows, requests)
    got = A.admit(t, make(draw.sample(requests, len(requests)), REQUEST).repartition(3), NOW)
    outcomes = [(r["seq"], r["kind"], r["id"], None) for r in got.applied.collect()] + [tuple(r) for r in got.rejected.select("seq", "kind", "id", "reason").collect()]
    assert sorted(outcomes, key=lambda r: r[0]) == want
    assert {(r["id"], r["account_id"], r["is_active"]) for r in got.tables.profiles.collect()} == {(k, *v) for k, v in rows.items()}
    assert {"account_full", "not_found", None} <= {r[3] for r in want}


def test_counts_are_what_each_request_meets(spark):
    """Above the cap at first: three releases bring six down to three, the fourth frees a place."""
    steps = [1, -1, -1, 1, -1, 1, -1, 1, 1]
    df = spark.createDataFrame([(1, 10**9 * k, s, 6, 3) for k, s in enumerate(steps)], "account_id long, seq long, step int, active long, cap long")
    got = [r["before"] for r in A.counts_before(df).orderBy("seq").collect()]
    assert got[-4:] == [3, 3, 2, 3] and all(x >= 3 for x in got[:6])


def made_up(spark, accounts: int, profiles: int) -> Tables:
    make = spark.createDataFrame
    return Tables(
        make([(1, "a", "i", "c", 2, None)], "id int, name string, icon string, color string, max_profiles int, created_on date"),
        make([(i, 1, "e", "p", None, None, None) for i in range(1, accounts + 1)], "id long, platform_id int, email string, provider_name string, cost decimal(10,2), expiry_date date, created_on date"),
        make(
            [(i, 1 + i % accounts, "p", "c", "w", None, None, True, None) for i in range(1, profiles + 1)],
            "id long, account_id long, profile_name string, client_name string, client_whatsapp string, sale_price decimal(10,2), expiry_date date, is_active boolean, created_at timestamp_ntz",
        ),
        make([], RENEWALS),
    )


def chained(n: int) -> list:
    """Each insert is followed by its own release, so what is void hangs on the one before."""
    out = []
    for k in range(n):
        out.append((2 * k, A.INSERT, None, 1, "N", "C"))
        out.append((2 * k + 1, A.RELEASE, 1 + (2 * k if k % 3 else 2 * k - 2) + 1, None, None, None))
    return out


@pytest.mark.parametrize("bucket", [4096, 8])
def test_releases_of_rejected_inserts(spark, monkeypatch, bucket):
    """An account's list, or many scans for one that is longer than a bucket, give the same as one by one."""
    t, requests, labels = made_up(spark, 2, 1), chained(30), []
    keep, whole = A.stage, A.apart
    monkeypatch.setattr(A, "stage", lambda d, label: (labels.append(label), keep(d, label))[1])
    monkeypatch.setattr(A, "apart", lambda d, keys: whole(d, keys, bucket))
    res = A.admit(t, spark.createDataFrame(requests, REQUEST), NOW)
    got = res.applied.withColumn("reason", F.lit(None).cast("string")).unionByName(res.rejected)
    want = one_by_one({1: 2, 2: 2}, {1: [2, True]}, requests)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if bucket == 4096:
        assert "admission" not in labels  # no round of scans
    assert res.tables.profiles.where("is_active").count() == sum(r[3] is None and r[1] == A.INSERT for r in want) + 1 - sum(r[3] is None and r[1] == A.RELEASE for r in want)
