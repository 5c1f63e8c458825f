"""Physical plan checks: no Python UDFs, no Expand, pushdown, broadcast of the dimension."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries
from seatledger.catalog import AS_OF
from seatledger.operators import history as H
from seatledger.operators import reports as R
from seatledger.sources.bindings import bind_tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return bind_tables(spark, SF)


def test_no_python_udf_anywhere(spark):
    for name, fn in queries().items():
        p = plan(fn(spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


@pytest.mark.parametrize("name", ["platform_report", "platform_list", "summary", "platform_expiry_stats"])
def test_no_expand(spark, name):
    assert "Expand" not in plan(queries()[name](spark, SF))


def test_summary_scans_each_table_once(tables):
    text = plan(R.summary(tables, AS_OF))
    # orders feeds profiles (once) and nothing else in the summary except the log binding
    assert text.count("orders.parquet") == 2  # profiles + renewals binding
    assert text.count("lineitem.parquet") == 1


def test_pushdown_reaches_scan(tables):
    text = plan(H.renewal_history(tables, "1999-01-01", "1999-12-31"))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text


def test_dimension_is_broadcast(tables):
    text = plan(R.expiring_soon(tables, AS_OF))
    assert "BroadcastHashJoin" in text


def test_history_limit_scans_the_log_once(tables):
    # the bounded selection is staged as Parquet; the lookups read it, not the log
    text = plan(H.renewal_history(tables, limit=100))
    assert "lineitem.parquet" not in text and "TakeOrderedAndProject" not in text


def test_history_lookups_push_a_key_range(tables):
    # the at most `limit` picked keys bound the lookups' scans by id range
    df = H.renewal_history(tables, limit=100)
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)  # full filter lists
    assert "GreaterThanOrEqual(o_orderkey" in text and "LessThanOrEqual(o_orderkey" in text
    assert "GreaterThanOrEqual(c_custkey" in text and "LessThanOrEqual(c_custkey" in text


def test_platform_lists_filter_before_aggregating(tables):
    from seatledger.operators import lists as L

    semi = re.compile(r"\[account_id#\d+L\], \[account_id#\d+L\], LeftSemi")
    # profiles and the log, cut to the platform's accounts before their aggregates
    assert len(semi.findall(plan(L.account_list(tables, 3)))) == 2
    assert len(semi.findall(plan(R.platform_detail(tables, 3, AS_OF)))) == 1
    assert not semi.findall(plan(L.account_list(tables)))  # no platform, no cut


def test_renewals_meet_profiles_before_accounts(tables, monkeypatch):
    """The batch is joined to profiles first and only then to accounts: the
    labels of all active profiles (a profiles x accounts join) are never built."""
    from seatledger import requests as Q
    from seatledger.operators import changes as C

    seen = []
    real = C.stage

    def spy(df, label):
        seen.append(plan(df))
        return real(df, label)

    monkeypatch.setattr(C, "stage", spy)
    C.renew_profiles(tables, Q.renew_profiles_req(tables), Q.NOW)
    text = seen[0]
    # outermost: the account lookup; inside it: the profile lookup of the batch
    assert text.index("isnotnull(account_id") < text.index("isnotnull(profile_id")
    assert not re.search(r"\[account_id#\d+L\], \[id#\d+L\], Inner", text)
