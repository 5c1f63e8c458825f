"""Account and profile lists and detail lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..model import RENEWAL_PROFILE, Tables, money
from ..plans.joins import restrict_all_to_keys
from .reports import _profiles_with_labels
from .rollups import profiles_per_account, renewals_per

LABEL_COLUMNS = ["account_email", "account_cost", "platform_name", "platform_icon", "platform_color"]


def _account_revenue(t: Tables, accounts: DataFrame) -> DataFrame:
    """Accounts with active profile count and total revenue.

    total_revenue = active profiles' prices + every 'profile' renewal logged
    for the account, including renewals of profiles deleted since.
    """
    per = profiles_per_account(t.profiles).select(F.col("account_id").alias("id"), "n_active", "revenue_active")
    ren = renewals_per(t.renewals.where(F.col("renewal_type") == RENEWAL_PROFILE), "account_id")
    ren = ren.select(F.col("account_id").alias("id"), "renewal_revenue")
    out = accounts.join(per, "id", "left").join(ren, "id", "left")
    return out.select(
        *accounts.columns,
        F.coalesce(F.col("n_active"), F.lit(0)).cast("bigint").alias("profile_count"),
        money(F.coalesce(F.col("revenue_active"), F.lit(0)) + F.coalesce(F.col("renewal_revenue"), F.lit(0))).alias(
            "total_revenue"
        ),
    )


def account_list(t: Tables, platform_id: int | None = None) -> DataFrame:
    """Accounts of a platform (all platforms when ``platform_id`` is None)."""
    acc = t.accounts
    if platform_id is not None:
        acc = acc.where(F.col("platform_id") == F.lit(platform_id).cast("int"))
        # the platform's profiles and log rows only, when its account set is small
        profiles, renewals = restrict_all_to_keys([t.profiles, t.renewals], "account_id", acc, "id")
        t = t.with_(profiles=profiles, renewals=renewals)
    return _account_revenue(t, acc).orderBy(F.col("created_on").desc_nulls_first(), F.col("id"))


def account_detail(t: Tables, account_id: int) -> DataFrame:
    """One account with its platform labels, max_profiles and R4 measures."""
    acc = t.accounts.where(F.col("id") == F.lit(account_id).cast("bigint"))
    pl = t.platforms.select(
        F.col("id").alias("platform_id"),
        F.col("name").alias("platform_name"),
        F.col("icon").alias("platform_icon"),
        F.col("color").alias("platform_color"),
        "max_profiles",
    )
    acc = acc.join(pl, "platform_id").select(*t.accounts.columns, *pl.columns[1:])
    return _account_revenue(t, acc)


def profile_list(t: Tables, account_id: int | None = None) -> DataFrame:
    """Active profiles of an account (every account when None) with labels."""
    pr = t.profiles.where(P.is_active())
    if account_id is not None:
        pr = pr.where(F.col("account_id") == F.lit(account_id).cast("bigint"))
    out = _profiles_with_labels(t, pr).select(*t.profiles.columns, *LABEL_COLUMNS)
    return out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))


def profile_detail(t: Tables, profile_id: int) -> DataFrame:
    """One active profile with labels; no row when missing or deleted."""
    pr = t.profiles.where(P.is_active() & (F.col("id") == F.lit(profile_id).cast("bigint")))
    return _profiles_with_labels(t, pr).select(*t.profiles.columns, *LABEL_COLUMNS)
