"""Exact distinct counts that merge (A3, A4): who was renewed, by month and platform.

A plain ``count(distinct)`` cannot be added up: an account renewed in two months,
or a profile moved to another platform, counts once in a total. Here each group
keeps its ids as bitmaps, one for each 32,768 ids (``bitmap_bucket_number``), and
coarser groups (a range of months, all platforms, the total row) are the bitwise
or of finer ones. So the log is read once, its bitmaps can be stored, those of new
log rows are added beside them, and no later report reads the log.

Scale: ids are made distinct before any bitmap is built (partial aggregation, so
an id that holds a third of the log is one row a task and group), and the rows of
one bitmap are at most the 32,768 ids it has room for, whatever the platform's
size. A bitmap is 4 KB before compression; bitmaps of few ids are mostly zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RENEWAL_ACCOUNT, Tables

RENEWED = ("accounts", "profiles", "accounts_paid")


def id_bitmaps(rows: DataFrame, keys: dict[str, Column], ids: dict[str, Column]) -> DataFrame:
    """(keys, kind, bucket, bits): each group's ids of each kind; null ids are in none."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("bigint").alias("id")) for k, c in ids.items()]))
    by = [*keys, "kind", "bucket"]
    marks = (
        rows.select(*[c.alias(k) for k, c in keys.items()], each.alias("e")).where("e.id IS NOT NULL")
        .select(*keys, "e.kind", F.bitmap_bucket_number("e.id").alias("bucket"), F.bitmap_bit_position("e.id").alias("bit"))
        .distinct()
    )
    # ids travel as numbers: bitmaps are built after the shuffle, not for each task before it
    return marks.repartition(*by).groupBy(*by).agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge(bits: DataFrame, keys: list[str]) -> DataFrame:
    """The bitmaps of coarser groups; also of stored and added ones together."""
    return bits.groupBy(*keys, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(bits: DataFrame, keys: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """One row a group with the number of distinct ids of each kind."""
    n = F.bitmap_count("bits")
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).cast("bigint").alias(k) for k in kinds]
    return merge(bits, keys).groupBy(*keys).agg(*sums)


def renewal_bitmaps(t: Tables) -> DataFrame:
    """The log's bitmaps by month and platform: accounts and profiles named by any
    renewal, and accounts renewed as such."""
    paid = F.when(F.col("renewal_type") == RENEWAL_ACCOUNT, F.col("account_id"))
    keys = {"month": F.date_format("created_at", "yyyy-MM"), "platform_id": F.col("platform_id")}
    return id_bitmaps(t.renewals, keys, dict(zip(RENEWED, (F.col("account_id"), F.col("profile_id"), paid))))


def renewed_monthly(bits: DataFrame) -> DataFrame:
    """Distinct accounts and profiles renewed in each month, over all platforms."""
    return distinct_counts(bits, ["month"], RENEWED)


def renewed_platforms(bits: DataFrame, first: str, last: str) -> DataFrame:
    """Distinct accounts and profiles renewed in a range of months (yyyy-MM) for each
    platform, and a total row (A13), which is less than the sum where platforms share ids."""
    some = bits.where(F.col("month").between(first, last))
    per = distinct_counts(some, ["platform_id"], RENEWED).withColumn("is_total", F.lit(False))
    whole = distinct_counts(some, [], RENEWED).select(F.lit(None).cast("int").alias("platform_id"), *RENEWED, F.lit(True).alias("is_total"))
    return per.unionByName(whole)
