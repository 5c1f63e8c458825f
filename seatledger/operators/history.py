"""Time series over sales and the renewal log (R13 - R15) and renewal history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions import text as X
from ..model import LOG_PARTITION, MONEY_OUT, RENEWAL_ACCOUNT, Tables, money_sum
from ..plans.joins import left_join_dimension, left_join_spread_nulls, pick_keys
from ..sources.tables import stage

DAILY_DATES = 30  # fixed value: newest dates shown by the sales report
MONTHS = 12  # fixed value: newest months shown by the monthly report
# Above this LIMIT the history joins the whole filtered log instead of a
# broadcast of the selected keys.
HISTORY_BROADCAST_LIMIT = 100_000


# ------------------------------------------------------------------- R13
def sales_daily(t: Tables, n: int = DAILY_DATES) -> DataFrame:
    """Profiles sold per calendar date (price > 0, deleted included).

    Newest ``n`` dates that have rows, no gap filling. The aggregate is
    partial per task; the top-n is a TakeOrderedAndProject, no global sort.
    """
    g = (
        t.profiles.where(P.positive("sale_price"))
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("profiles_sold"), money_sum("sale_price").alias("revenue"))
    )
    return g.orderBy(F.col("date").desc_nulls_first()).limit(n)


def renewals_daily(t: Tables, n: int = DAILY_DATES) -> DataFrame:
    """Renewals per calendar date (price > 0; both types mixed)."""
    priced = t.renewals.where(P.positive("sale_price"))
    # n dates lie in the newest months that hold so many: at least one a month
    g = (
        _newest_months(priced, n)
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("renewals_count"), money_sum("sale_price").alias("renewal_revenue"))
    )
    return g.orderBy(F.col("date").desc_nulls_first()).limit(n)


# ------------------------------------------------------------------- R15
def _month() -> F.Column:
    return F.date_format("created_at", "yyyy-MM")


def _newest_months(log: DataFrame, n: int) -> DataFrame:
    """The part of a stored log that can hold its newest ``n`` labels (months, or dates).

    Each month that has rows holds at least one label, so the newest ``n``
    months do; they are found from the partition column alone (at most one
    value a month leaves Spark), and become a partition filter with the null
    month, which sorts first. A log without that column is returned as it is.
    """
    if LOG_PARTITION not in log.columns:
        return log
    month = F.col(LOG_PARTITION)
    known = log.where(month.isNotNull()).select(month.alias("m")).distinct().orderBy(F.desc("m")).limit(n)
    least = min((r["m"] for r in known.collect()), default=None)
    return log if least is None else log.where(month.isNull() | (month >= F.lit(least)))


def _months_by_type(t: Tables, n: int) -> DataFrame:
    """Rows and revenue by month and type: one scan of the newest months."""
    log = _newest_months(t.renewals, n)
    return log.groupBy(_month().alias("month"), "renewal_type").agg(
        F.count(F.lit(1)).alias("renewal_count"), money_sum("sale_price").alias("revenue")
    )


def monthly(t: Tables, n: int = MONTHS) -> DataFrame:
    """Renewals per month label, both types, zero prices counted; newest n."""
    g = _months_by_type(t, n).groupBy("month").agg(F.sum("renewal_count").alias("renewal_count"), money_sum("revenue").alias("revenue"))
    return g.orderBy(F.col("month").desc_nulls_first()).limit(n)


def monthly_by_type(t: Tables, n: int = MONTHS) -> DataFrame:
    """R15 split by renewal_type (cost vs revenue), same newest n months.

    The months are ranked over the grouped rows (two for each month), not over
    the log, so the log is scanned once.
    """
    newest = Window.orderBy(F.col("month").desc_nulls_first())
    g = _months_by_type(t, n).withColumn("__place", F.dense_rank().over(newest))
    return g.where(F.col("__place") <= n).drop("__place")


# ------------------------------------------------------------------- R14
def month_range(date_from: str | None, date_to: str | None) -> F.Column:
    """Predicate on the log's month partition column implied by a date range,
    from the same parsed bounds as the row predicate."""
    m, cond = F.col(LOG_PARTITION), F.lit(True)
    low, high = P.parse_range(date_from, date_to)
    if low is not None:
        cond = cond & (m >= F.lit(f"{low.year:04d}-{low.month:02d}"))
    if high is not None:
        cond = cond & (m <= F.lit(f"{high.year:04d}-{high.month:02d}"))
    return cond


def history_order(columns: list[str]) -> list[F.Column]:
    """Newest first (null dates first, as the original database sorts), then
    every other log column, so that a LIMIT cuts at a well defined row."""
    rest = [F.col(c).asc_nulls_first() for c in columns if c != "created_at"]
    return [F.col("created_at").desc_nulls_first(), *rest]


def _newest_rows(log: DataFrame, n: int) -> DataFrame:
    """The part of a stored log that holds its newest ``n`` rows: whole months from the newest
    down until they have so many, as a partition filter. Rows are counted by month (for a log
    without other filters from the files' footers alone; one row a month leaves Spark); the null
    month sorts first."""
    month = F.col(LOG_PARTITION)
    counts = {r["m"]: r["n"] for r in log.groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left, months = n - counts.pop(None, 0), []
    for m in sorted(counts, reverse=True):
        if left <= 0:
            break
        months.append(m)
        left -= counts[m]
    return log.where(month.isNull() | (month >= F.lit(months[-1]))) if months else log.where(month.isNull())


def _selected_log(t: Tables, date_from, date_to, limit) -> tuple[DataFrame, int | None]:
    """The log rows the history shows: in the range, newest first, at most ``limit``
    (of a stored log, only the months that can hold those are sorted)."""
    cols = [c for c in t.renewals.columns if c != LOG_PARTITION]
    r = t.renewals.where(P.created_between("created_at", date_from, date_to))
    if LOG_PARTITION in t.renewals.columns:
        # month partitions outside the range are skipped without being read
        r = r.where(month_range(date_from, date_to))
    n = None if limit in (None, "") else int(limit)
    if n is not None:
        if LOG_PARTITION in r.columns:
            r = _newest_rows(r, n)
        r = r.orderBy(*history_order(cols)).limit(n)
    return r.select(*cols), n


def renewal_history(t: Tables, date_from: str | None = None, date_to: str | None = None, limit=None) -> DataFrame:
    """The log with live labels where the row still exists, else snapshots.

    The joins are left joins on unique keys, so they keep one row per log row
    and the LIMIT can be taken first: a top-k on the log alone, then only the
    selected keys are looked up (broadcast semi joins with a bound of
    ``limit`` keys). Without a limit the whole filtered log is joined; null
    profile ids (account renewals) are spread so they do not meet in one task.
    A live blank value wins over a snapshot; only a missing row falls back.
    """
    cols = [c for c in t.renewals.columns if c != LOG_PARTITION]
    r, n = _selected_log(t, date_from, date_to, limit)

    p = t.profiles.select(F.col("id").alias("__p_id"), *[F.col(c).alias("__p_" + c) for c in ("profile_name", "client_name", "client_whatsapp")])
    a = t.accounts.select(F.col("id").alias("__a_id"), F.col("email").alias("__a_email"))
    pl = t.platforms.select(
        F.col("id").alias("__pl_id"),
        F.col("name").alias("__pl_name"),
        F.col("icon").alias("__pl_icon"),
        F.col("color").alias("__pl_color"),
    )
    if n is not None and n <= HISTORY_BROADCAST_LIMIT:
        # the selected rows (at most n) are computed once, written to the
        # shared checkpoint folder and reused by the three key lookups
        r = stage(r, "history")
        # key ranges of both lookups from one small aggregate over the staged rows
        b = r.agg(F.min("profile_id"), F.max("profile_id"), F.min("account_id"), F.max("account_id")).first()
        p = pick_keys(p, "__p_id", r, "profile_id", bounds=(b[0], b[1]))
        a = pick_keys(a, "__a_id", r, "account_id", bounds=(b[2], b[3]))
        j = r.join(p, r["profile_id"] == p["__p_id"], "left")
        j = j.join(a, j["account_id"] == a["__a_id"], "left")
    else:
        j = left_join_spread_nulls(r, p, "profile_id", "__p_id", salt_cols=cols)
        j = left_join_spread_nulls(j, a, "account_id", "__a_id", salt_cols=cols)
    j = left_join_dimension(j, pl, "platform_id", "__pl_id", salt_cols=cols)

    live = {
        "profile_name": ("__p_id", "__p_profile_name"),
        "client_name": ("__p_id", "__p_client_name"),
        "client_whatsapp": ("__p_id", "__p_client_whatsapp"),
        "account_email": ("__a_id", "__a_email"),
        "platform_name": ("__pl_id", "__pl_name"),
        "platform_icon": ("__pl_id", "__pl_icon"),
        "platform_color": ("__pl_id", "__pl_color"),
    }
    out = []
    for c in cols:
        if c in live:
            key, val = live[c]
            # a matched row's value wins even when blank; coalesce is what the
            # original does (a null live value cannot occur: NOT NULL columns)
            out.append(F.coalesce(F.col(val), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    res = j.select(*out)
    return res.orderBy(*history_order(cols))


def renewal_history_total(t: Tables, date_from: str | None = None, date_to: str | None = None, limit=None) -> DataFrame:
    """Count and price total of the returned rows (after the limit).

    The history's label joins are left joins on unique keys: they keep every
    row and do not touch ``sale_price``, so the total is taken from the
    selected log rows directly, without the joins.
    """
    r, _ = _selected_log(t, date_from, date_to, limit)
    return r.agg(F.count(F.lit(1)).alias("count"), money_sum("sale_price").alias("total_revenue"))


def write_history(t: Tables, path: str, date_from: str | None = None, date_to: str | None = None, limit=None) -> DataFrame:
    """SNK1: the history's rows, written to ``path/rows``, and its envelope (count and
    price total of those rows) as one row, written to ``path/envelope`` and returned.

    The envelope is observed by the job that writes the rows, so nothing is
    read or sorted a second time.
    """
    seen = Observation("envelope")
    rows = renewal_history(t, date_from, date_to, limit)
    rows.observe(seen, F.count(F.lit(1)).alias("count"), money_sum("sale_price").alias("total_revenue")).write.parquet(f"{path}/rows")
    spark = t.renewals.sparkSession
    envelope = spark.createDataFrame([(seen.get["count"], seen.get["total_revenue"])], T.StructType().add("count", "long").add("total_revenue", MONEY_OUT))
    envelope.coalesce(1).write.parquet(f"{path}/envelope")
    return spark.read.schema(envelope.schema).parquet(f"{path}/envelope")


def renewal_display(history: DataFrame) -> DataFrame:
    """the history table as shown: item, who, date texts, price text."""
    acct = F.col("renewal_type") == RENEWAL_ACCOUNT
    return history.select(
        "*",
        F.when(acct, F.col("account_email")).otherwise(F.col("profile_name")).alias("item_text"),
        F.when(acct, F.lit("Cuenta"))
        .when(F.coalesce(F.col("client_name"), F.lit("")) == "", F.lit("—"))
        .otherwise(F.col("client_name"))
        .alias("who_text"),
        F.when(F.col("old_expiry_date").isNull(), F.lit("—"))
        .otherwise(X.long_date_text("old_expiry_date"))
        .alias("old_date_text"),
        X.long_date_text("new_expiry_date").alias("new_date_text"),
        X.money_text("sale_price").alias("price_text"),
    )

