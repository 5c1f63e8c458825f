"""Portfolio reports: summary, per-platform money, expiry reports, alerts.

Every report takes ``Tables`` (and ``as_of`` where "today" matters) and
returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..model import RENEWAL_ACCOUNT, RENEWAL_PROFILE, Tables, money, money_sum
from ..plans.joins import dimension, restrict_to_keys
from .rollups import per_platform, renewals_per

PLATFORM_LABELS = ["id", "name", "icon", "color"]


def _zero(name: str) -> F.Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


# --------------------------------------------------------------------- R8
def summary(t: Tables, as_of: dt.date) -> DataFrame:
    """One row with the ten measures, profit and the 'soon' card total.

    One conditional aggregate per table (one scan each, instead of the
    original's five scans of profiles), combined by a union of the four
    one-row frames and a last global aggregate; no join is needed.
    """
    active = P.is_active()
    pr = t.profiles.agg(
        F.count_if(active).alias("total_profiles"),
        F.count_if(active & P.non_blank("client_name")).alias("active_clients"),
        money_sum("sale_price").alias("profile_revenue"),
        F.count_if(active & P.expired("expiry_date", as_of)).alias("expired_profiles"),
        F.count_if(active & P.expiring_soon("expiry_date", as_of)).alias("expiring_soon_profiles"),
    )
    ac = t.accounts.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        money_sum("cost").alias("account_cost"),
        F.count_if(P.expired("expiry_date", as_of)).alias("expired_accounts"),
        F.count_if(P.expiring_soon("expiry_date", as_of)).alias("expiring_soon_accounts"),
    )
    kind = F.col("renewal_type")
    rn = t.renewals.agg(
        money_sum(F.when(kind == RENEWAL_ACCOUNT, F.col("sale_price"))).alias("renewal_cost"),
        money_sum(F.when(kind == RENEWAL_PROFILE, F.col("sale_price"))).alias("renewal_revenue"),
    )
    pl = t.platforms.agg(F.count(F.lit(1)).alias("total_platforms"))
    one = pl.unionByName(ac, allowMissingColumns=True)
    one = one.unionByName(pr, allowMissingColumns=True).unionByName(rn, allowMissingColumns=True)
    counts = [
        "total_platforms",
        "total_accounts",
        "total_profiles",
        "active_clients",
        "expired_profiles",
        "expiring_soon_profiles",
        "expired_accounts",
        "expiring_soon_accounts",
    ]
    moneys = ["account_cost", "renewal_cost", "profile_revenue", "renewal_revenue"]
    row = one.agg(
        *[F.max(c).cast("bigint").alias(c) for c in counts],
        *[F.max(c).alias(c) for c in moneys],
    )
    costs = money(F.col("account_cost") + F.col("renewal_cost"))
    revenue = money(F.col("profile_revenue") + F.col("renewal_revenue"))
    return row.select(
        *counts[:4],
        costs.alias("total_costs"),
        revenue.alias("total_revenue"),
        *counts[4:],
        money(revenue - costs).alias("total_profit"),
        (F.col("expiring_soon_profiles") + F.col("expiring_soon_accounts")).alias("expiring_soon_total"),
        (revenue >= costs).alias("profit_non_negative"),
    )


# --------------------------------------------------------------------- R9
def platform_report(t: Tables) -> DataFrame:
    """``platform_figures``, the most profitable first."""
    return platform_figures(t).orderBy(F.col("profit").desc(), F.col("id"))


def platform_figures(t: Tables) -> DataFrame:
    """Accounts, active profiles, cost, revenue and profit per platform, in no order.

    Renewals are matched by the log's own platform_id, so those of deleted
    accounts still count; revenue includes soft-deleted profiles.
    """
    per = per_platform(t.accounts, t.profiles).withColumnRenamed("platform_id", "id")
    ren = renewals_per(t.renewals, "platform_id").withColumnRenamed("platform_id", "id")
    out = t.platforms.select(*PLATFORM_LABELS).join(per, "id", "left").join(ren, "id", "left")
    cost = money(F.coalesce(F.col("account_cost"), F.lit(0)) + F.coalesce(F.col("renewal_cost"), F.lit(0)))
    revenue = money(F.coalesce(F.col("profile_revenue"), F.lit(0)) + F.coalesce(F.col("renewal_revenue"), F.lit(0)))
    return out.select(
        *PLATFORM_LABELS,
        _zero("account_count").alias("account_count"),
        _zero("profile_count_active").alias("profile_count"),
        cost.alias("total_cost"),
        revenue.alias("total_revenue"),
        money(revenue - cost).alias("profit"),
    )


def platform_report_total(t: Tables) -> DataFrame:
    """The per-platform table plus its total row (numeric sums, T2).

    ``rollup`` over the platform id gives the detail rows and the grand total
    in one aggregation; ``is_total`` marks the total row.
    """
    rep = platform_figures(t)
    g = rep.rollup("id").agg(
        F.first("name").alias("name"),
        F.sum("account_count").cast("bigint").alias("account_count"),
        F.sum("profile_count").cast("bigint").alias("profile_count"),
        money(F.sum("total_cost")).alias("total_cost"),
        money(F.sum("total_revenue")).alias("total_revenue"),
        money(F.sum("profit")).alias("profit"),
        (F.grouping_id() == 1).alias("is_total"),
    )
    return g.select(
        "id",
        F.when(F.col("is_total"), F.lit("Total")).otherwise(F.col("name")).alias("name"),
        "account_count",
        "profile_count",
        "total_cost",
        "total_revenue",
        "profit",
        "is_total",
        (F.col("profit") >= 0).alias("profit_non_negative"),
    )


# ------------------------------------------------------------ R10 - R12
def _accounts_with_platform(t: Tables) -> DataFrame:
    pl = dimension(t.platforms).select(
        F.col("id").alias("platform_id"),
        F.col("name").alias("platform_name"),
        F.col("icon").alias("platform_icon"),
        F.col("color").alias("platform_color"),
    )
    return t.accounts.join(pl, "platform_id")


def _profiles_with_labels(t: Tables, profiles: DataFrame | None = None) -> DataFrame:
    """Profiles joined to their account and platform labels (inner joins)."""
    a = _accounts_with_platform(t).select(
        F.col("id").alias("account_id"),
        F.col("email").alias("account_email"),
        F.col("cost").alias("account_cost"),
        "platform_id",
        "platform_name",
        "platform_icon",
        "platform_color",
    )
    return (t.profiles if profiles is None else profiles).join(a, "account_id")


def _expiry_pair(t: Tables, acc_pred, prof_pred) -> DataFrame:
    acc = (
        _accounts_with_platform(t)
        .where(acc_pred(F.col("expiry_date")))
        .select(
            F.lit(RENEWAL_ACCOUNT).alias("type"),
            "id",
            "email",
            "expiry_date",
            "platform_name",
            "platform_icon",
            "platform_color",
            F.lit(None).cast("string").alias("profile_name"),
            F.lit(None).cast("string").alias("client_name"),
        )
    )
    prof = (
        _profiles_with_labels(t, t.profiles.where(P.is_active() & prof_pred(F.col("expiry_date"))))
        .select(
            F.lit(RENEWAL_PROFILE).alias("type"),
            "id",
            "account_email",
            "expiry_date",
            "platform_name",
            "platform_icon",
            "platform_color",
            "profile_name",
            "client_name",
        )
    )
    return acc.unionByName(prof, allowMissingColumns=True).orderBy("type", "expiry_date", "id")


def expiring_soon(t: Tables, as_of: dt.date) -> DataFrame:
    """Accounts and active profiles with today < expiry <= today + 7."""
    return _expiry_pair(t, lambda c: P.expiring_soon(c, as_of), lambda c: P.expiring_soon(c, as_of))


def expired(t: Tables, as_of: dt.date) -> DataFrame:
    """Accounts and active profiles with expiry <= today."""
    return _expiry_pair(t, lambda c: P.expired(c, as_of), lambda c: P.expired(c, as_of))


def expiring_within(t: Tables, as_of: dt.date, days=7) -> DataFrame:
    """Everything due within ``days`` (expired included), wide columns."""
    acc = (
        _accounts_with_platform(t)
        .where(P.due_within("expiry_date", as_of, days))
        .select(F.lit(RENEWAL_ACCOUNT).alias("type"), *t.accounts.columns, "platform_name", "platform_icon", "platform_color")
    )
    prof = (
        _profiles_with_labels(t, t.profiles.where(P.is_active() & P.due_within("expiry_date", as_of, days)))
        .select(
            F.lit(RENEWAL_PROFILE).alias("type"),
            *t.profiles.columns,
            "account_email",
            "platform_name",
            "platform_icon",
            "platform_color",
        )
    )
    return acc.unionByName(prof, allowMissingColumns=True).orderBy("type", "expiry_date", "id")


def expiring_within_counts(t: Tables, as_of: dt.date, days=7) -> DataFrame:
    """The group sizes shown in the R12 headings, one row per type."""
    return expiring_within(t, as_of, days).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ R1 - R3, R16
def platform_list(t: Tables, as_of: dt.date) -> DataFrame:
    """Platforms with account/profile counts and the four expiry counts.

    profile_count counts soft-deleted profiles too; the expiry counts are over
    account-profile join rows (an account with n profiles counts n times).
    """
    per = per_platform(t.accounts, t.profiles, as_of).withColumnRenamed("platform_id", "id")
    out = t.platforms.join(per, "id", "left")
    return out.select(
        *t.platforms.columns,
        _zero("account_count").alias("account_count"),
        _zero("profile_count_all").alias("profile_count"),
        _zero("expired_accounts").alias("expired_accounts"),
        _zero("expiring_soon_accounts").alias("expiring_soon_accounts"),
        _zero("expired_profiles").alias("expired_profiles"),
        _zero("expiring_soon_profiles").alias("expiring_soon_profiles"),
    ).orderBy(F.col("created_on").desc_nulls_first(), F.col("id"))


def platform_detail(t: Tables, platform_id: int, as_of: dt.date) -> DataFrame:
    """R1 for one platform id; no row when it does not exist."""
    pid = F.lit(platform_id).cast("int")
    accounts = t.accounts.where(F.col("platform_id") == pid)
    sub = t.with_(
        platforms=t.platforms.where(F.col("id") == pid),
        accounts=accounts,
        # only this platform's profiles are aggregated when its account set is small
        profiles=restrict_to_keys(t.profiles, "account_id", accounts, "id"),
    )
    return platform_list(sub, as_of)


def platform_expiry_stats(t: Tables, as_of: dt.date, distinct: bool = False) -> DataFrame:
    """R2 for every platform (platforms without accounts get zeros).

    ``distinct=True`` counts each expired / expiring account once instead of
    once per profile row.
    """
    per = per_platform(t.accounts, t.profiles, as_of).withColumnRenamed("platform_id", "id")
    sfx = "_distinct" if distinct else ""
    out = t.platforms.select("id").join(per, "id", "left")
    return out.select(
        "id",
        _zero("expired_accounts" + sfx).alias("expired_accounts"),
        _zero("expiring_soon_accounts" + sfx).alias("expiring_soon_accounts"),
        _zero("expired_profiles").alias("expired_profiles"),
        _zero("expiring_soon_profiles").alias("expiring_soon_profiles"),
    )


# Alert texts and marks of the platform cards.
ALERT_TEXT = {
    "expired_accounts": ("expired", "🔴", "cuenta(s) vencida(s)"),
    "expiring_soon_accounts": ("warning", "🟡", "cuenta(s) por vencer"),
    "expired_profiles": ("expired", "🔴", "perfil(es) vencido(s)"),
    "expiring_soon_profiles": ("warning", "🟡", "perfil(es) por vencer"),
}


def platform_alerts(t: Tables, as_of: dt.date) -> DataFrame:
    """The non-zero R2 counts as one row per (platform, kind)."""
    stats = platform_expiry_stats(t, as_of)
    kinds = list(ALERT_TEXT)
    long = stats.unpivot("id", kinds, "kind", "n").where(F.col("n") > 0)
    kind = F.col("kind")
    severity = mark = label = F.lit(None).cast("string")
    for k, (sev, sign, text) in ALERT_TEXT.items():
        severity = F.when(kind == k, F.lit(sev)).otherwise(severity)
        mark = F.when(kind == k, F.lit(sign)).otherwise(mark)
        label = F.when(kind == k, F.lit(text)).otherwise(label)
    return long.select(
        F.col("id").alias("platform_id"),
        "kind",
        "n",
        severity.alias("severity"),
        F.concat_ws(" ", mark, F.col("n").cast("string"), label).alias("text"),
    )
