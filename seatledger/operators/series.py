"""Expiry counts for a range of reporting dates in one pass.

A row's date decides all its counts: it is expired on its date and after, and due
within n days on the n days before (and, for R12, after too). So rows are only
counted by date, dates before the range taken as its first day, and the counts of
every reporting date are sums over a window of days: one partial aggregate over
each table, however many dates are asked for, and windows of at most
the range's days for each platform.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..model import Tables

SOON = 7  # fixed value: days that count as soon


def _day(first: dt.date, last: dt.date, ahead: int) -> Column:
    """Days from ``first`` to a row's date; dates before count as ``first``, those no reporting date looks at are null."""
    date = F.col("expiry_date")
    return F.when(date <= F.date_add(F.lit(last), ahead), F.greatest(F.date_diff(date, F.lit(first)), F.lit(0)))


def _days(first: dt.date, last: dt.date, ahead: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit((last - first).days + ahead))).alias("day")


def _until(by: list[str], name: str, days: int = 0) -> Column:
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, days)
    return F.sum(name).over(w).cast("bigint")


def _next(by: list[str], name: str) -> Column:
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(1, SOON)
    return F.coalesce(F.sum(name).over(w), F.lit(0)).cast("bigint")


def _reported(d: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Only reporting dates, as dates."""
    return d.where(F.col("day") <= (last - first).days).withColumn("as_of", F.date_add(F.lit(first), F.col("day"))).drop("day")


def platform_expiry_series(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """R2 of every platform for each reporting date from ``first`` to ``last``:
    as_of, id and the four counts (accounts once for each of their profiles, T1)."""
    day = _day(first, last, SOON)
    # profiles by account and date; a hot account is summed up before the shuffle
    per = t.profiles.groupBy("account_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    times = per.groupBy("account_id").agg(F.sum("n").alias("times"))
    accounts = t.accounts.select(F.col("id").alias("account_id"), "platform_id", day.alias("day"))
    profiles = per.where(F.col("day").isNotNull()).join(accounts.select("account_id", "platform_id"), "account_id")
    held = accounts.join(times, "account_id", "left").where(F.col("day").isNotNull())
    rows = held.select("platform_id", "day", F.greatest(F.col("times"), F.lit(1)).alias("accounts"), F.lit(0).cast("bigint").alias("profiles"))
    rows = rows.unionByName(profiles.select("platform_id", "day", F.lit(0).cast("bigint").alias("accounts"), F.col("n").alias("profiles")))
    counts = rows.groupBy(F.col("platform_id").alias("id"), "day").agg(F.sum("accounts").alias("accounts"), F.sum("profiles").alias("profiles"))
    grid = t.platforms.select("id", _days(first, last, SOON)).join(counts, ["id", "day"], "left").fillna(0, ["accounts", "profiles"])
    out = grid.select(
        "id",
        "day",
        _until(["id"], "accounts").alias("expired_accounts"),
        _next(["id"], "accounts").alias("expiring_soon_accounts"),
        _until(["id"], "profiles").alias("expired_profiles"),
        _next(["id"], "profiles").alias("expiring_soon_profiles"),
    )
    return _reported(out, first, last)


def expiry_totals_series(t: Tables, first: dt.date, last: dt.date, days: int = SOON) -> DataFrame:
    """The expiry cards of R8 and the group sizes of R12 for each reporting date: as_of,
    accounts and active profiles that are expired, expire soon, or are due within ``days``."""
    ahead = max(SOON, days)
    day = _day(first, last, ahead)
    kinds = {"accounts": t.accounts, "profiles": t.profiles.where(P.is_active())}
    none = F.lit(0).cast("bigint")
    parts = [rows.select(day.alias("day"), *[(F.lit(1).cast("bigint") if k == name else none).alias(k) for k in kinds]) for name, rows in kinds.items()]
    counts = parts[0].unionByName(parts[1]).where(F.col("day").isNotNull()).groupBy("day").agg(*[F.sum(k).alias(k) for k in kinds])
    grid = t.platforms.sparkSession.range(1).select(_days(first, last, ahead)).join(counts, "day", "left").fillna(0, list(kinds))
    out = [F.col("day")]
    for k in kinds:  # one window of the range's days
        out += [_until([], k).alias(f"expired_{k}"), _next([], k).alias(f"expiring_soon_{k}"), _until([], k, days).alias(f"due_{k}")]
    return _reported(grid.select(*out), first, last)
