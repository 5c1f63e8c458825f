"""Rollups that follow changes (R9, A1-A8) without reading the tables again.

The sums that reports take over profiles and the log are kept by account and by
platform. A change says which rows it took out and which it put in
(``ChangeResult.changed``); those are added with their signs, account by
account. An account that ends takes its whole row along, so the profiles that
end with it need not be known. Only the rollups and the changed rows
are read: what a fold costs does not depend on the profiles or the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..model import Tables, money, money_sum
from .changes import ChangeResult
from .reports import PLATFORM_LABELS
from .rollups import accounts_with_profiles, renewals_per

SUMS = ["n_profiles", "n_active", "revenue_all", "revenue_active"]


@dataclass(frozen=True)
class Rollups:
    """``accounts``: id, platform_id, cost and its profiles' sums; ``platforms``: what the
    log sums up to by its own platform_id. Stored by the caller (``sources.tables.stage``)."""

    accounts: DataFrame
    platforms: DataFrame


def rollups(t: Tables) -> Rollups:
    """From whole tables."""
    return Rollups(accounts_with_profiles(t.accounts, t.profiles).select("id", "platform_id", "cost", *SUMS), renewals_per(t.renewals, "platform_id"))


def fold(stored: Rollups, change: ChangeResult) -> Rollups:
    """The rollups after a change of the tables that they were taken from."""
    (accounts_out, accounts_in), (out, in_), (_, log) = (change.changed[k] for k in ("accounts", "profiles", "renewals"))
    active = F.when(P.is_active(), 1).otherwise(0)
    signed = lambda rows, sign: rows.select(
        F.col("account_id").alias("id"),
        F.lit(sign).cast("bigint").alias("n_profiles"),
        (F.lit(sign) * active).cast("bigint").alias("n_active"),
        money(F.lit(sign) * F.col("sale_price")).alias("revenue_all"),
        money(F.lit(sign) * active * F.col("sale_price")).alias("revenue_active"),
    )
    moved = signed(out, -1).unionByName(signed(in_, 1)).groupBy("id").agg(*[F.sum(c).alias(f"more_{c}") for c in SUMS])
    now = accounts_in.select("id", F.col("platform_id").alias("new_platform_id"), F.col("cost").alias("new_cost"), F.lit(True).alias("stays"))
    ended = accounts_out.select("id").join(now.select("id"), "id", "left_anti")
    a = stored.accounts.join(ended, "id", "left_anti").join(now, "id", "full").join(moved, "id", "left")
    sums = [(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).cast(stored.accounts.schema[c].dataType).alias(c) for c in SUMS]
    accounts = a.select("id", F.coalesce("new_platform_id", "platform_id").alias("platform_id"), F.coalesce("new_cost", "cost").alias("cost"), *sums)
    added = renewals_per(log, "platform_id")
    both = stored.platforms.unionByName(added).groupBy("platform_id").agg(money_sum("renewal_cost").alias("renewal_cost"), money_sum("renewal_revenue").alias("renewal_revenue"))
    return Rollups(accounts, both)


def platform_figures_of(stored: Rollups, platforms: DataFrame) -> DataFrame:
    """R9 from rollups: accounts, active profiles, cost, revenue and profit by platform."""
    per = stored.accounts.groupBy(F.col("platform_id").alias("id")).agg(
        F.count(F.lit(1)).alias("account_count"), F.sum("n_active").cast("bigint").alias("profile_count"), money_sum("cost").alias("own_cost"), money_sum("revenue_all").alias("own_revenue")
    )
    log = stored.platforms.withColumnRenamed("platform_id", "id")
    d = platforms.select(*PLATFORM_LABELS).join(per, "id", "left").join(log, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost, revenue = money(zero("own_cost") + zero("renewal_cost")), money(zero("own_revenue") + zero("renewal_revenue"))
    return d.select(
        *PLATFORM_LABELS,
        zero("account_count").cast("bigint").alias("account_count"),
        zero("profile_count").cast("bigint").alias("profile_count"),
        cost.alias("total_cost"),
        revenue.alias("total_revenue"),
        money(revenue - cost).alias("profit"),
    ).orderBy(F.col("profit").desc(), F.col("id"))
