"""Data model: the four tables, their schemas and the money/count conventions.

platforms 1-n accounts 1-n profiles; ``renewals`` is an append-only log that
outlives the rows it names, so it carries copies (snapshots) of their labels.
``sale_price`` in the log is revenue for renewal_type 'profile' and cost for
'account'. Passwords and PINs are never carried.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# every money expression ends in this type, in Spark and in the DuckDB oracle.
# 38 digits: totals over a whole business grow with the data (the sum of
# 10^12 prices of up to 10^8 would overflow 18 digits), and DuckDB's sum of
# DECIMAL(10,2) is DECIMAL(38,2) already.
MONEY_OUT = T.DecimalType(38, 2)

PLATFORMS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("icon", T.StringType(), False),
        T.StructField("color", T.StringType(), False),
        T.StructField("max_profiles", T.IntegerType(), False),
        T.StructField("created_on", T.DateType(), True),
    ]
)

ACCOUNTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("platform_id", T.IntegerType(), False),
        T.StructField("email", T.StringType(), False),
        T.StructField("provider_name", T.StringType(), False),
        T.StructField("cost", MONEY, False),
        T.StructField("expiry_date", T.DateType(), True),
        T.StructField("created_on", T.DateType(), True),
    ]
)

PROFILES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("account_id", T.LongType(), False),
        T.StructField("profile_name", T.StringType(), False),
        T.StructField("client_name", T.StringType(), False),
        T.StructField("client_whatsapp", T.StringType(), False),
        T.StructField("sale_price", MONEY, False),
        T.StructField("expiry_date", T.DateType(), True),
        T.StructField("is_active", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)

RENEWALS = T.StructType(
    [
        T.StructField("profile_id", T.LongType(), True),
        T.StructField("account_id", T.LongType(), True),
        T.StructField("platform_id", T.IntegerType(), True),
        T.StructField("account_email", T.StringType(), False),
        T.StructField("platform_name", T.StringType(), False),
        T.StructField("profile_name", T.StringType(), False),
        T.StructField("client_name", T.StringType(), False),
        T.StructField("client_whatsapp", T.StringType(), False),
        T.StructField("platform_icon", T.StringType(), False),
        T.StructField("platform_color", T.StringType(), False),
        T.StructField("old_expiry_date", T.DateType(), True),
        T.StructField("new_expiry_date", T.DateType(), False),
        T.StructField("sale_price", MONEY, False),
        T.StructField("renewal_type", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)

# Stored logs are partitioned by this month label (yyyy-MM of created_at);
# operators keep it out of their results and use it for partition pruning.
LOG_PARTITION = "created_month"

# Column defaults of the original tables.
DEFAULT_ICON = "📺"
DEFAULT_COLOR = "#6c5ce7"
DEFAULT_MAX_PROFILES = 5
RENEWAL_PROFILE = "profile"
RENEWAL_ACCOUNT = "account"


@dataclass(frozen=True)
class Tables:
    """The four tables as DataFrames. Operators return new ``Tables``. ``version``:
    the stored version they were read from, if any."""

    platforms: DataFrame
    accounts: DataFrame
    profiles: DataFrame
    renewals: DataFrame
    version: int | None = None

    def with_(self, **kw) -> "Tables":
        return replace(self, **kw)


def money(c: Column | str) -> Column:
    """Final money type: sums of decimal(10,2) widen differently per engine."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY_OUT)


def money_sum(c: Column | str) -> Column:
    """``coalesce(sum(c), 0)`` as decimal(38,2): zero on empty input."""
    c = F.col(c) if isinstance(c, str) else c
    return money(F.coalesce(F.sum(c), F.lit(0)))


def ntz(ts) -> Column:
    """A wall-clock timestamp literal (timestamp_ntz), independent of the session zone."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def empty_like(df: DataFrame) -> DataFrame:
    """Same schema, no rows, no scan of the input at run time."""
    return df.limit(0)
