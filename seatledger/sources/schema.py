"""Seeding an empty platform table (SRC2) and conforming old tables (SRC3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import PLATFORMS, PROFILES, RENEWALS, Tables

# The five default platforms (name, icon, color, max_profiles).
DEFAULT_PLATFORMS = [
    ("Netflix", "🎬", "#E50914", 5),
    ("Disney+", "🏰", "#113CCF", 7),
    ("Prime Video", "📦", "#00A8E1", 6),
    ("HBO Max", "🎭", "#B834DB", 5),
    ("Spotify", "🎵", "#1DB954", 6),
]


def seed_defaults(spark: SparkSession, platforms: DataFrame, as_of: dt.date) -> DataFrame:
    """SRC2: the platforms, or the five defaults when the table is empty.

    The emptiness test is an EXISTS subquery evaluated once; no join.
    """
    rows = [(i + 1, n, icon, color, m, as_of) for i, (n, icon, color, m) in enumerate(DEFAULT_PLATFORMS)]
    defaults = spark.createDataFrame(rows, PLATFORMS)
    seeded = defaults.where(~platforms.exists())
    return platforms.unionByName(seeded)


# Defaults of the columns added to an old renewal log.
RENEWAL_DEFAULTS = {
    "account_email": "",
    "platform_name": "",
    "platform_icon": "",
    "platform_color": "",
    "profile_name": "",
    "client_name": "",
    "client_whatsapp": "",
    "renewal_type": "profile",
}


# Fixed value: profiles stored before soft deletion are all visible.
PROFILE_DEFAULTS = {"is_active": True}


def conform_schema(df: DataFrame, target: T.StructType, defaults: dict | None = None) -> DataFrame:
    """SRC3: add every missing column of ``target`` with its default (or null),
    cast to the declared type; existing columns are cast and kept in order."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = []
    for f in target.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in target.fields}]
    return df.select(*cols, *extra)


def conform_renewals(df: DataFrame) -> DataFrame:
    """An old renewal log (before the snapshot columns) in today's shape."""
    return conform_schema(df, RENEWALS, RENEWAL_DEFAULTS)


def conform_profiles(df: DataFrame) -> DataFrame:
    """Old profiles (before soft deletion) in today's shape: all active."""
    return conform_schema(df, PROFILES, PROFILE_DEFAULTS)


def adopt(t: Tables) -> Tables:
    """Tables of the original database as the operators want them.

    Platforms and accounts there carry a timestamp ``created_at``; here a date
    ``created_on`` stands for it. Other columns (``provider_phone``, the log's
    ``id``) are kept, and changes fill them.
    """

    def dated(df: DataFrame) -> DataFrame:
        if "created_at" not in df.columns or "created_on" in df.columns:
            return df
        return df.select(*[F.to_date(c).alias("created_on") if c == "created_at" else F.col(c) for c in df.columns])

    return t.with_(platforms=dated(t.platforms), accounts=dated(t.accounts))
