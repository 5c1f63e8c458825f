"""The history's date range: the same rows from a stored log as from an unstored one, however the dates are written."""

from __future__ import annotations

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest

from seatledger.functions.predicates import parse_moment, parse_range
from seatledger.operators import history as H
from seatledger.sources.bindings import bind_tables
from seatledger.sources.tables import read_tables, write_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    t = bind_tables(spark, SF)
    path = str(tmp_path_factory.mktemp("log"))
    write_tables(t, path)
    return t, read_tables(spark, path)


@pytest.mark.parametrize(
    "low, high",
    [("1999-01-05", "1999-12-31"), ("1999-1-5", "1999-3-7"), ("1999-3-05", None), (None, "1999-1-31"), ("", ""), ("1999-02-01 12:30", None), (dt.date(1999, 4, 1), dt.date(1999, 5, 1))],
)
def test_stored_and_unstored_logs_agree(logs, low, high):
    a, b = (H.renewal_history_total(t, low, high, None).first() for t in logs)
    assert tuple(a) == tuple(b) and a["count"] > 0


@pytest.mark.parametrize("bad", ["1999-13-01", "yesterday", "1999-02-30", "99-1-1", "1999-1-1; x"])
def test_invalid_dates_are_rejected(logs, bad):
    for t in logs:
        with pytest.raises(ValueError):
            H.renewal_history(t, bad, None)


def test_parsing():
    assert parse_moment("1999-1-5") == dt.datetime(1999, 1, 5) == parse_moment("1999-01-05 ")
    assert parse_moment("1999-1-5T7:08:09.5") == dt.datetime(1999, 1, 5, 7, 8, 9, 500000)
    assert parse_range(None, "1999-1-5") == (None, dt.datetime(1999, 1, 5, 23, 59, 59))
    with pytest.raises(ValueError):
        parse_range(None, "1999-01-05 10:00")


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_newest_months_prune_the_stored_log(logs):
    for query in (H.monthly, H.monthly_by_type, H.renewals_daily):
        a, b = (sorted(map(tuple, query(t).collect()), key=repr) for t in logs)
        assert a == b
        text = plan(query(logs[1]))
        assert "created_month" in text.split("PartitionFilters: ", 1)[1].split("\n")[0]
        assert text.count("Location: ") == 1


def test_the_whole_history_is_ordered(logs):
    rows = [r["created_at"] for r in H.renewal_history(logs[0]).collect()]
    assert rows == sorted(rows, reverse=True)
