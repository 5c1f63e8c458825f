from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seatledger.model import ACCOUNTS, PLATFORMS, PROFILES, RENEWALS, Tables  # noqa: E402
from seatledger.session import local_session  # noqa: E402

AS_OF = dt.date(2000, 1, 1)


def day(n: int) -> dt.date:
    return AS_OF + dt.timedelta(days=n)


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="seatledger-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def golden(spark) -> Tables:
    """The hand-made rows of FIXTURES.md section 3."""
    D = Decimal
    platforms = [
        (1, "Alpha", "A", "#000001", 2, dt.date(1999, 1, 1)),
        (2, "Beta", "B", "#000002", 5, dt.date(1999, 1, 2)),
    ]
    accounts = [
        (10, 1, "a10@x", "prov", D("10.00"), day(0), dt.date(1999, 2, 1)),
        (11, 1, "a11@x", "prov", D("4.50"), None, dt.date(1999, 2, 2)),
        (12, 1, "a12@x", "prov", D("0.00"), day(7), dt.date(1999, 2, 3)),
    ]
    ts = dt.datetime(1999, 6, 1)
    profiles = [
        (100, 10, "P100", "Ana", "+54 (11) 1-2", D("3.00"), day(0), True, ts),
        (101, 10, "P101", "Luis", "5411", D("3.50"), day(1), True, ts),
        (102, 10, "P102", "Eva", "5412", D("9.99"), day(-5), False, ts),
        (103, 12, "P103", "", "", D("0.00"), day(7), True, ts),
        (104, 12, "P104", "Ian", "5413", D("2.00"), day(8), True, ts),
        (105, 12, "P105", "Zoe", "5414", D("2.00"), None, True, ts),
    ]

    def log(pid, acc, plat, kind, price, created):
        blank = kind == "account"
        return (
            pid,
            acc,
            plat,
            f"old{acc}@x",
            f"Old {plat}",
            "" if blank else f"OldP{pid}",
            "" if blank else "Old Client",
            "" if blank else "549",
            "o",
            "#ffffff",
            day(-10),
            day(20),
            D(price),
            kind,
            created,
        )

    renewals = [
        log(100, 10, 1, "profile", "3.00", dt.datetime(1999, 12, 31, 23, 59, 59)),
        log(100, 10, 1, "profile", "3.00", dt.datetime(1999, 12, 31, 23, 59, 59, 500000)),
        log(None, 10, 1, "account", "8.00", dt.datetime(1999, 12, 1)),
        log(999, 99, 9, "profile", "7.00", dt.datetime(1999, 11, 30, 12)),
        log(103, 12, 1, "profile", "0.00", None),
    ]
    return Tables(
        platforms=spark.createDataFrame(platforms, PLATFORMS),
        accounts=spark.createDataFrame(accounts, ACCOUNTS),
        profiles=spark.createDataFrame(profiles, PROFILES),
        renewals=spark.createDataFrame(renewals, RENEWALS),
    )
