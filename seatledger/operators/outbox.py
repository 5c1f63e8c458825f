"""Customer notices as a batch job (N1 - N4) and per-row display columns.

The original opened one chat link per click in the browser. Here every
eligible profile gets its message text and link in one pass; sending them is
left to whoever consumes the frame.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..model import RENEWAL_ACCOUNT, RENEWAL_PROFILE, Tables
from ..plans.joins import matching, small_enough
from .reports import _accounts_with_platform, _profiles_with_labels, platform_figures
from .rollups import profiles_per_account


def _with_phone_and_days(t: Tables, as_of: dt.date) -> DataFrame:
    pr = t.profiles.where(P.is_active() & P.non_blank("client_whatsapp"))
    return _profiles_with_labels(t, pr).withColumn("days_left", X.days_until("expiry_date", as_of))


def reminder_outbox(t: Tables, as_of: dt.date) -> DataFrame:
    """Active profiles with a phone whose date is still ahead (days > 0)."""
    p = _with_phone_and_days(t, as_of).where(F.col("days_left") > 0)
    msg = X.reminder_message("client_name", "platform_name", "days_left")
    return p.select(
        F.col("id").alias("profile_id"),
        "account_id",
        "client_whatsapp",
        "days_left",
        msg.alias("message"),
    ).withColumn("link", X.chat_link("client_whatsapp", "message"))


def expiry_outbox(t: Tables, as_of: dt.date) -> DataFrame:
    """Active profiles with a phone due today or overdue (days <= 0)."""
    p = _with_phone_and_days(t, as_of).where(F.col("days_left") <= 0)
    msg = X.expiry_message("client_name", "platform_name")
    return p.select(
        F.col("id").alias("profile_id"),
        "account_id",
        "client_whatsapp",
        "days_left",
        msg.alias("message"),
    ).withColumn("link", X.chat_link("client_whatsapp", "message"))


def _notices(rows: DataFrame, *keep: str) -> DataFrame:
    """N3's text and link for rows with a phone, from labels at hand."""
    msg = X.renewal_message("platform_name", "account_email", "profile_name", None, "new_expiry_date")
    told = rows.where(P.non_blank("client_whatsapp")).select(*keep, "client_whatsapp", msg.alias("message"))
    return told.withColumn("link", X.chat_link("client_whatsapp", "message"))


def _notified(rows: DataFrame, requests: DataFrame | None) -> DataFrame:
    """Without the rows whose request said not to notify (a ``notify`` column, true where missing or null)."""
    if requests is None or "notify" not in requests.columns:
        return rows
    return rows.join(requests.where(~F.col("notify")).select("seq"), "seq", "left_anti")


def renewal_outbox(t: Tables, log_rows: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """A confirmation for each new 'profile' log row whose profile has a phone.

    ``log_rows`` are the rows the renewal wrote (``ChangeResult.applied``); they
    carry phone, profile, email and platform of the live rows already, so
    nothing is looked up. ``requests`` may carry the notify flag. The account
    password is not carried, a placeholder stands in its place.
    """
    rows = log_rows.where(F.col("renewal_type") == RENEWAL_PROFILE)
    return _notices(_notified(rows, requests), "seq", "profile_id")


def creation_outbox(t: Tables, new_profiles: DataFrame) -> DataFrame:
    """N3 after creation: the same notice for each inserted profile with a phone.

    ``t`` holds the tables after the change, ``new_profiles`` the rows it wrote;
    only the accounts that they name meet their platforms.
    """
    rows = new_profiles.where(P.non_blank("client_whatsapp"))
    acc = matching(t.accounts, "id", rows, "account_id", small_enough(rows))
    acc = _accounts_with_platform(t.with_(accounts=acc)).select(
        F.col("id").alias("account_id"), F.col("email").alias("account_email"), "platform_name"
    )
    rows = rows.withColumnsRenamed({"id": "profile_id", "expiry_date": "new_expiry_date"})
    return _notices(rows.join(acc, "account_id"), "profile_id", "account_id")


def profile_display(profiles: DataFrame) -> DataFrame:
    """the texts of a profile card, with its words for what is missing."""
    price = F.when(P.positive("sale_price"), X.money_text("sale_price")).otherwise(F.lit("No definido"))
    return profiles.select(
        "id",
        _or("client_name", "Sin asignar").alias("client_text"),
        _or("client_whatsapp", "No registrado").alias("phone_text"),
        price.alias("price_text"),
        X.long_date_text("expiry_date").alias("expiry_text"),
    )


def expiring_display(rows: DataFrame) -> DataFrame:
    """the texts of the expiry report (``expiring_within``), a dash for what is missing."""
    acct = F.col("type") == RENEWAL_ACCOUNT
    return rows.select(
        "type",
        "id",
        F.concat_ws(" ", "platform_icon", "platform_name").alias("platform_text"),
        F.when(acct, _or("provider_name", "—")).otherwise(_or("client_name", "—")).alias("who_text"),
        X.money_text(F.when(acct, F.col("cost")).otherwise(F.col("sale_price"))).alias("amount_text"),
        X.long_date_text("expiry_date").alias("expiry_text"),
    )


def _or(c: str, text: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(text)).otherwise(F.col(c))


# ------------------------------------------------------- display columns
def expiry_buckets(t: Tables, as_of: dt.date) -> DataFrame:
    """F9 over accounts and active profiles: days left and the expiry badge."""

    def badge(df: DataFrame, kind: str) -> DataFrame:
        b = X.expiry_badge("expiry_date", as_of)
        return df.select(F.lit(kind).alias("type"), "id", "expiry_date", *[c.alias(k) for k, c in b.items()])

    return badge(t.accounts, RENEWAL_ACCOUNT).unionByName(badge(t.profiles.where(P.is_active()), RENEWAL_PROFILE))


def account_occupancy(t: Tables) -> DataFrame:
    """active profiles against the platform's max_profiles, per account."""
    per = profiles_per_account(t.profiles).select(F.col("account_id").alias("id"), "n_active")
    acc = t.accounts.select("id", "platform_id").join(per, "id", "left")
    acc = acc.select("id", "platform_id", F.coalesce(F.col("n_active"), F.lit(0)).cast("bigint").alias("profile_count"))
    pl = t.platforms.select(F.col("id").alias("platform_id"), "max_profiles")
    j = acc.join(pl, "platform_id")
    return j.select(
        "id",
        "platform_id",
        "profile_count",
        "max_profiles",
        X.occupancy_pct("profile_count", "max_profiles").alias("occupancy_pct"),
        X.is_full("profile_count", "max_profiles").alias("is_full"),
    )


def money_texts(t: Tables) -> DataFrame:
    """F13 over the per-platform report: cost, revenue and profit as text."""
    rep = platform_figures(t)
    return rep.select(
        "id",
        X.money_text("total_cost").alias("total_cost_text"),
        X.money_text("total_revenue").alias("total_revenue_text"),
        X.money_text("profit").alias("profit_text"),
    )


def long_date_texts(t: Tables) -> DataFrame:
    """F14 over every profile's expiry date."""
    return t.profiles.select("id", "expiry_date", X.long_date_text("expiry_date").alias("expiry_text"))
