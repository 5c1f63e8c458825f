"""

Each query derives the four tables from the driver's Parquet files and runs
section 7 (as_of 2000-01-01, platform 3, account 73, profile 951, history
1999-01-01 .. 1999-12-31 limit 100, 30 days).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle_sql as O
from .model import RENEWALS
from .operators import history as H
from .operators import lists as L
from .operators import reports as R
from .sources.bindings import bind_tables
from .sources.tables import materialize

AS_OF = dt.date(2000, 1, 1)
PLATFORM_ID = 3
ACCOUNT_ID = 73
PROFILE_ID = 951
HIST_FROM, HIST_TO, HIST_LIMIT = "1999-01-01", "1999-12-31", 100
WITHIN_DAYS = 30

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(bind_tables(spark, sf_dir, AS_OF))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = O.with_bindings(sql)
        return fn

    return deco


# ------------------------------------------------------------------ reports
register("platform_report", O.PLATFORM_REPORT)(lambda t: R.platform_report(t))
register("platform_report_total", O.PLATFORM_REPORT_TOTAL)(lambda t: R.platform_report_total(t))
register("summary", O.SUMMARY)(lambda t: R.summary(t, AS_OF))
register("platform_list", O.platform_list_sql())(lambda t: R.platform_list(t, AS_OF))
register("platform_detail", O.platform_list_sql(f"WHERE p.id = {PLATFORM_ID}"))(
    lambda t: R.platform_detail(t, PLATFORM_ID, AS_OF)
)
register("platform_expiry_stats", O.PLATFORM_EXPIRY_STATS)(lambda t: R.platform_expiry_stats(t, AS_OF))
register("platform_expiry_stats_distinct", O.PLATFORM_EXPIRY_STATS_DISTINCT)(
    lambda t: R.platform_expiry_stats(t, AS_OF, distinct=True)
)
register("platform_alerts", O.PLATFORM_ALERTS)(lambda t: R.platform_alerts(t, AS_OF))
register("expiring_soon", O.EXPIRING_SOON)(lambda t: R.expiring_soon(t, AS_OF))
register("expired", O.EXPIRED)(lambda t: R.expired(t, AS_OF))
register("expiring_within", O.expiring_within_sql(WITHIN_DAYS))(lambda t: R.expiring_within(t, AS_OF, WITHIN_DAYS))
register("expiring_within_counts", O.expiring_within_counts_sql(WITHIN_DAYS))(
    lambda t: R.expiring_within_counts(t, AS_OF, WITHIN_DAYS)
)

# -------------------------------------------------------------------- lists
register("account_list", O.account_list_sql(None))(lambda t: L.account_list(t))
register("account_list_platform", O.account_list_sql(PLATFORM_ID))(lambda t: L.account_list(t, PLATFORM_ID))
register("account_detail", O.account_detail_sql(ACCOUNT_ID))(lambda t: L.account_detail(t, ACCOUNT_ID))
register("profile_list", O.profile_list_sql(""))(lambda t: L.profile_list(t))
register("profile_list_account", O.profile_list_sql(f"p.account_id = {ACCOUNT_ID} AND"))(
    lambda t: L.profile_list(t, ACCOUNT_ID)
)
register("profile_detail", O.profile_list_sql(f"p.id = {PROFILE_ID} AND"))(lambda t: L.profile_detail(t, PROFILE_ID))

# ------------------------------------------------------------------- series
register("sales_daily", O.SALES_DAILY)(lambda t: H.sales_daily(t))
register("renewals_daily", O.RENEWALS_DAILY)(lambda t: H.renewals_daily(t))
register("monthly", O.MONTHLY)(lambda t: H.monthly(t))
register("monthly_by_type", O.MONTHLY_BY_TYPE)(lambda t: H.monthly_by_type(t))
register("renewal_history", O.renewal_history_sql(HIST_FROM, HIST_TO, HIST_LIMIT))(
    lambda t: H.renewal_history(t, HIST_FROM, HIST_TO, HIST_LIMIT)
)
register("renewal_history_total", O.renewal_history_total_sql(HIST_FROM, HIST_TO, HIST_LIMIT))(
    lambda t: H.renewal_history_total(t, HIST_FROM, HIST_TO, HIST_LIMIT)
)
register("renewal_history_all", O.renewal_history_sql(None, None, None))(lambda t: H.renewal_history(t))

# --------------------------------------------------------- display columns
from .operators import changes as C  # noqa: E402
from .operators import outbox as N  # noqa: E402
from . import requests as Q  # noqa: E402
from .sources import schema as S  # noqa: E402

register("expiry_buckets", O.EXPIRY_BUCKETS)(lambda t: N.expiry_buckets(t, AS_OF))
register("account_occupancy", O.ACCOUNT_OCCUPANCY)(lambda t: N.account_occupancy(t))
register("money_text", O.MONEY_TEXT)(lambda t: N.money_texts(t))
register("long_date_text", O.LONG_DATE_TEXT)(lambda t: N.long_date_texts(t))
register("renewal_display", O.renewal_display_sql(HIST_FROM, HIST_TO, HIST_LIMIT))(
    lambda t: H.renewal_display(H.renewal_history(t, HIST_FROM, HIST_TO, HIST_LIMIT))
)

# ------------------------------------------------------------------ outbox
register("reminder_outbox", O.REMINDER_OUTBOX)(lambda t: N.reminder_outbox(t, AS_OF))
register("expiry_outbox", O.EXPIRY_OUTBOX)(lambda t: N.expiry_outbox(t, AS_OF))


def _renewal_outbox(t):
    res = C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW)
    return N.renewal_outbox(res.tables, res.applied)


register("renewal_outbox", O.renewal_outbox_sql(Q.RENEW_PROFILES_REQ, Q.NOW_SQL))(_renewal_outbox)

# ----------------------------------------------------------- change batches
register("insert_platforms", O.insert_platforms_sql(Q.INSERT_PLATFORMS_REQ, Q.AS_OF_SQL))(
    lambda t: C.insert_platforms(t, Q.insert_platforms_req(t), AS_OF).applied
)
register("insert_accounts", O.insert_accounts_sql(Q.INSERT_ACCOUNTS_REQ, Q.AS_OF_SQL))(
    lambda t: C.insert_accounts(t, Q.insert_accounts_req(t), AS_OF).applied
)
register("insert_profiles", O.insert_profiles_sql(Q.INSERT_PROFILES_REQ, Q.NOW_SQL))(
    lambda t: C.insert_profiles(t, Q.insert_profiles_req(t), Q.NOW).applied
)
register("admit_within_capacity", O.admit_within_capacity_sql(Q.INSERT_PROFILES_REQ, Q.NOW_SQL))(
    lambda t: C.insert_profiles(t, Q.insert_profiles_req(t), Q.NOW, enforce_capacity=True).applied
)
register("validate_changes", O.validate_changes_sql(Q.INSERT_PROFILES_REQ))(
    lambda t: C.validate_changes(Q.insert_profiles_req(t), "account_id", "profile_name", "client_name")
)
register("update_platforms", O.update_platforms_sql(Q.UPDATE_PLATFORMS_REQ))(
    lambda t: C.update_platforms(t, Q.update_platforms_req(t)).tables.platforms
)
register("update_accounts", O.update_accounts_sql(Q.UPDATE_ACCOUNTS_REQ, keep_expiry=False))(
    lambda t: C.update_accounts(t, Q.update_accounts_req(t)).tables.accounts
)
register("keep_expiry_on_blank", O.update_accounts_sql(Q.UPDATE_ACCOUNTS_REQ, keep_expiry=True))(
    lambda t: C.update_accounts(t, Q.update_accounts_req(t), keep_expiry_on_blank=True).tables.accounts
)
register("update_profiles", O.update_profiles_sql(Q.UPDATE_PROFILES_REQ))(
    lambda t: C.update_profiles(t, Q.update_profiles_req(t)).tables.profiles
)
register("merge_profiles", O.merge_profiles_sql(Q.MERGE_PROFILES_REQ))(
    lambda t: C.merge_profiles(t, Q.merge_profiles_req(t)).tables.profiles
)
register("soft_delete_profiles", O.soft_delete_sql(Q.SOFT_DELETE_REQ))(
    lambda t: C.soft_delete_profiles(t, Q.soft_delete_req(t)).tables.profiles
)
register("delete_accounts", O.delete_accounts_sql(Q.DELETE_ACCOUNTS_REQ))(
    lambda t: C.delete_accounts(t, Q.delete_accounts_req(t)).tables.profiles
)
register("delete_platforms", O.delete_platforms_sql(Q.DELETE_PLATFORMS_REQ))(
    lambda t: C.delete_platforms(t, Q.delete_platforms_req(t)).tables.profiles
)
register("reset_data", O.RESET_REPORT)(lambda t: C.reset_report(t, C.reset_data(t)))
register("renew_profiles", O.renew_profiles_sql(Q.RENEW_PROFILES_REQ, Q.NOW_SQL))(
    lambda t: C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW).applied
)
register("renew_accounts", O.renew_accounts_sql(Q.RENEW_ACCOUNTS_REQ, Q.NOW_SQL))(
    lambda t: C.renew_accounts(t, Q.renew_accounts_req(t), Q.NOW).applied
)
register("renewal_target_date", O.renewal_target_sql(Q.TARGET_DAYS_REQ, Q.AS_OF_SQL))(
    lambda t: C.renewal_target_date(t, Q.target_days_req(t), AS_OF)
)

# ----------------------------------------------------------------- sources
register("seed_defaults", O.seed_defaults_sql(Q.AS_OF_SQL))(
    lambda t: S.seed_defaults(t.platforms.sparkSession, t.platforms, AS_OF)
)
register("conform_schema", O.CONFORM_SCHEMA)(
    lambda t: S.conform_renewals(t.renewals.select("profile_id", "new_expiry_date", "sale_price", "created_at"))
)
register("conform_profiles", O.CONFORM_PROFILES)(
    lambda t: S.conform_profiles(t.profiles.drop("is_active", "client_whatsapp"))
)


# ------------------------------------- what else a change gives: rejections, other tables
def _rejected(name: str, sql: str, change: Callable) -> None:
    register(f"{name}_rejected", sql)(lambda t: change(t).rejected.select("seq", "reason"))


_rejected("insert_accounts", O.rejected_insert_sql(Q.INSERT_ACCOUNTS_REQ, "accounts"), lambda t: C.insert_accounts(t, Q.insert_accounts_req(t), AS_OF))
_rejected("insert_profiles", O.rejected_insert_sql(Q.INSERT_PROFILES_REQ, "profiles"), lambda t: C.insert_profiles(t, Q.insert_profiles_req(t), Q.NOW))
_rejected("update_accounts", O.rejected_update_sql(Q.UPDATE_ACCOUNTS_REQ, "accounts"), lambda t: C.update_accounts(t, Q.update_accounts_req(t)))
_rejected("update_profiles", O.rejected_update_sql(Q.UPDATE_PROFILES_REQ, "profiles"), lambda t: C.update_profiles(t, Q.update_profiles_req(t)))
_rejected("delete_accounts", O.rejected_delete_sql(Q.DELETE_ACCOUNTS_REQ, "accounts"), lambda t: C.delete_accounts(t, Q.delete_accounts_req(t)))
_rejected("renew_profiles", O.rejected_renewal_sql(Q.RENEW_PROFILES_REQ, "profile_id"), lambda t: C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW))
_rejected("renew_accounts", O.rejected_renewal_sql(Q.RENEW_ACCOUNTS_REQ, "account_id"), lambda t: C.renew_accounts(t, Q.renew_accounts_req(t), Q.NOW))
register("renew_profiles_table", O.renewed_table_sql(Q.RENEW_PROFILES_REQ, "profiles"))(
    lambda t: C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW).tables.profiles
)
register("renew_accounts_table", O.renewed_table_sql(Q.RENEW_ACCOUNTS_REQ, "accounts"))(
    lambda t: C.renew_accounts(t, Q.renew_accounts_req(t), Q.NOW).tables.accounts
)
register("delete_platforms_accounts", O.delete_platforms_accounts_sql(Q.DELETE_PLATFORMS_REQ))(
    lambda t: C.delete_platforms(t, Q.delete_platforms_req(t)).tables.accounts
)
# a stored log (months as partitions) with dates that are not padded
register("renewal_history_stored", O.renewal_history_sql("1999-01-05", "1999-03-07", None))(
    lambda t: H.renewal_history(materialize(t.platforms.sparkSession, t, "history"), "1999-1-5", "1999-3-7")
)
register("profile_display", O.PROFILE_DISPLAY)(lambda t: N.profile_display(L.profile_list(t)))
register("expiring_display", O.expiring_display_sql(WITHIN_DAYS))(lambda t: N.expiring_display(R.expiring_within(t, AS_OF, WITHIN_DAYS)))


def _creation_outbox(t):
    res = C.insert_profiles(t, Q.insert_profiles_req(t), Q.NOW)
    return N.creation_outbox(res.tables, res.applied)


register("creation_outbox", O.creation_outbox_sql(Q.INSERT_PROFILES_REQ, Q.NOW_SQL))(_creation_outbox)

# ------------------------------------------------- requests of every kind in one batch
from .operators import admission as D  # noqa: E402
from .operators import replay as Y  # noqa: E402

LOG_COLUMNS = [f.name for f in RENEWALS]


def _replayed(t):
    return Y.replay(t, Q.replay_req(t), AS_OF, Q.NOW)


register("replay_outcomes", O.replay_outcomes_sql(Q.REPLAY_REQ, Q.AS_OF_SQL))(
    lambda t: Y.outcomes(t, Q.replay_req(t)).select("seq", "kind", "id", "reason")
)
register("replay_log", O.replay_log_sql(Q.REPLAY_REQ, Q.AS_OF_SQL, Q.NOW_SQL))(lambda t: _replayed(t).appended["renewals"].select(*LOG_COLUMNS))
register("replay_platforms", O.replay_table_sql(Q.REPLAY_REQ, Q.AS_OF_SQL, Q.NOW_SQL, "platforms"))(lambda t: _replayed(t).tables.platforms)
register("replay_accounts", O.replay_table_sql(Q.REPLAY_REQ, Q.AS_OF_SQL, Q.NOW_SQL, "accounts"))(lambda t: _replayed(t).tables.accounts)
register("replay_profiles", O.replay_table_sql(Q.REPLAY_REQ, Q.AS_OF_SQL, Q.NOW_SQL, "profiles"))(lambda t: _replayed(t).tables.profiles)


def _admitted(t):
    res = D.admit(t, Q.admission_req(t), Q.NOW)
    return res.applied.withColumn("reason", F.lit(None).cast("string")).unionByName(res.rejected)


register("admit_with_releases", O.admission_sql(Q.ADMISSION_REQ))(_admitted)

# ------------------------------------------------- a range of reporting dates, written results
from .operators import series as E  # noqa: E402
from .sources.tables import folder  # noqa: E402

FIRST_DAY, LAST_DAY = dt.date(1999, 12, 15), dt.date(2000, 2, 15)
register("platform_expiry_series", O.platform_expiry_series_sql(str(FIRST_DAY), str(LAST_DAY)))(lambda t: E.platform_expiry_series(t, FIRST_DAY, LAST_DAY))
register("expiry_totals_series", O.expiry_totals_series_sql(str(FIRST_DAY), str(LAST_DAY), WITHIN_DAYS))(
    lambda t: E.expiry_totals_series(t, FIRST_DAY, LAST_DAY, WITHIN_DAYS)
)
register("renewal_history_newest", O.renewal_history_sql(None, None, HIST_LIMIT))(
    lambda t: H.renewal_history(materialize(t.platforms.sparkSession, t, "newest"), limit=HIST_LIMIT)
)
register("renewal_history_envelope", O.renewal_history_total_sql(HIST_FROM, HIST_TO, HIST_LIMIT))(
    lambda t: H.write_history(t, folder(t.platforms.sparkSession, "history"), HIST_FROM, HIST_TO, HIST_LIMIT)
)

# ------------------------------------------------- reports that follow a change
from .operators import increments as I  # noqa: E402
from .sources.tables import stage  # noqa: E402


def _report_after(t):
    stored = I.rollups(t)
    stored = I.Rollups(stage(stored.accounts, "rollups"), stage(stored.platforms, "rollups"))
    res = _replayed(t)
    return I.platform_figures_of(I.fold(stored, res), res.tables.platforms)


register("platform_report_after", O.platform_report_after_sql(Q.REPLAY_REQ, Q.AS_OF_SQL, Q.NOW_SQL))(_report_after)
# a batch in which every third request has no date and every fifth names no account
register("renew_accounts_some_rejected", O.rejected_renewal_sql(Q.RENEW_SOME_ACCOUNTS_REQ, "account_id"))(
    lambda t: C.renew_accounts(t, Q.renew_some_accounts_req(t), Q.NOW).rejected.select("seq", "reason")
)

# ------------------------------------------------- distinct counts that merge
from .operators import distinct as U  # noqa: E402

FIRST_MONTH, LAST_MONTH = "1998-10", "1999-09"
register("renewed_distinct_monthly", O.RENEWED_MONTHLY)(lambda t: U.renewed_monthly(stage(U.renewal_bitmaps(t), "bitmaps")))
register("renewed_distinct_platforms", O.renewed_platforms_sql(FIRST_MONTH, LAST_MONTH))(
    lambda t: U.renewed_platforms(stage(U.renewal_bitmaps(t), "bitmaps"), FIRST_MONTH, LAST_MONTH)
)
