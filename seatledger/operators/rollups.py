"""Shared two-level pre-aggregates.

The original queries join platforms -> accounts -> profiles and then count or
sum over the fan-out (one row per profile). Here the fan-out is never built:
profiles are aggregated per account (partial aggregation, so an account with a
third of all profiles is combined map-side), joined 1:1 to their account, and
aggregated again per platform. Counts that the original takes over join rows
(an account with three profiles counted three times) are reproduced by
weighting each account by ``greatest(n_profiles, 1)``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..model import RENEWAL_ACCOUNT, RENEWAL_PROFILE, money, money_sum


def profiles_per_account(profiles: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """account_id, n_profiles, n_active, revenue_all, revenue_active[, expiry counts]."""
    aggs = [
        F.count(F.lit(1)).alias("n_profiles"),
        F.count_if(P.is_active()).alias("n_active"),
        money_sum("sale_price").alias("revenue_all"),
        money_sum(F.when(P.is_active(), F.col("sale_price")).otherwise(F.lit(0))).alias("revenue_active"),
    ]
    if as_of is not None:
        aggs += [
            F.count_if(P.expired("expiry_date", as_of)).alias("n_expired"),
            F.count_if(P.expiring_soon("expiry_date", as_of)).alias("n_soon"),
        ]
    return profiles.groupBy("account_id").agg(*aggs)


def renewals_per(renewals: DataFrame, key: str) -> DataFrame:
    """Renewal cost ('account') and revenue ('profile') per key of the log."""
    kind = F.col("renewal_type")
    return (
        renewals.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            money_sum(F.when(kind == RENEWAL_ACCOUNT, F.col("sale_price"))).alias("renewal_cost"),
            money_sum(F.when(kind == RENEWAL_PROFILE, F.col("sale_price"))).alias("renewal_revenue"),
        )
    )


def accounts_with_profiles(accounts: DataFrame, profiles: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Every account with its per-account profile aggregate (zeros when none)."""
    per = profiles_per_account(profiles, as_of).withColumnRenamed("account_id", "id")
    out = accounts.join(per, "id", "left")
    zero_cols = ["n_profiles", "n_active"] + (["n_expired", "n_soon"] if as_of is not None else [])
    return out.fillna(0, subset=zero_cols).withColumns(
        {
            "revenue_all": _zero_money("revenue_all"),
            "revenue_active": _zero_money("revenue_active"),
        }
    )


def _zero_money(name: str) -> F.Column:
    """A pre-aggregated money column after an outer join: null becomes 0."""
    return money(F.coalesce(F.col(name), F.lit(0)))


def per_platform(accounts: DataFrame, profiles: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """One aggregate per platform id over the account rollup.

    Always: account_count, profile_count_all (soft-deleted included),
    profile_count_active, account_cost, profile_revenue (all profiles).
    With ``as_of``: the four expiry counts of R2, over join rows (T1), and the
    same account counts taken once per account (``*_distinct``).
    """
    a = accounts_with_profiles(accounts, profiles, as_of)
    aggs = [
        F.count(F.lit(1)).alias("account_count"),
        F.sum("n_profiles").cast("bigint").alias("profile_count_all"),
        F.sum("n_active").cast("bigint").alias("profile_count_active"),
        money_sum("cost").alias("account_cost"),
        money_sum("revenue_all").alias("profile_revenue"),
    ]
    if as_of is not None:
        rows = F.greatest(F.col("n_profiles"), F.lit(1))
        exp = P.expired("expiry_date", as_of)
        soon = P.expiring_soon("expiry_date", as_of)
        aggs += [
            F.sum(F.when(exp, rows).otherwise(0)).cast("bigint").alias("expired_accounts"),
            F.sum(F.when(soon, rows).otherwise(0)).cast("bigint").alias("expiring_soon_accounts"),
            F.sum("n_expired").cast("bigint").alias("expired_profiles"),
            F.sum("n_soon").cast("bigint").alias("expiring_soon_profiles"),
            F.count_if(exp).alias("expired_accounts_distinct"),
            F.count_if(soon).alias("expiring_soon_accounts_distinct"),
        ]
    return a.groupBy("platform_id").agg(*aggs)
