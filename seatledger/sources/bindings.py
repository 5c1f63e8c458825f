"""Derive the four domain tables from the driver's TPC-H-style Parquet files.

The mapping is fixed by FIXTURES.md (section 2) so that the DuckDB oracle can
build the same rows from the same files. Every customer is an account, every
order a profile and every line a log row. Some log rows name a profile, an
account or a platform that does not exist (a negative id, platform 99), as if it
had been deleted since: the outer joins and snapshot fallbacks of the reports
exist for those. Platform 24 has no accounts and every tenth account has no
profiles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MONEY, Tables

AS_OF = dt.date(2000, 1, 1)


def read_source(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Parquet scan with an explicit projection (column pruning at the source)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _days(base: F.Column, n: F.Column) -> F.Column:
    return F.date_add(base, n.cast("int"))


def bind_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_source(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    key = F.col("n_nationkey")
    return n.select(
        key.cast("int").alias("id"),
        F.col("n_name").alias("name"),
        F.substring("n_name", 1, 1).alias("icon"),
        F.concat(F.lit("#0000"), F.lpad(key.cast("string"), 2, "0")).alias("color"),
        (F.lit(4) + key % 8).cast("int").alias("max_profiles"),
        _days(F.lit(dt.date(1994, 1, 1)), key).alias("created_on"),
    )


def bind_accounts(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> DataFrame:
    c = read_source(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    return c.select(
        key.alias("id"),
        F.when(nation == 24, 23).otherwise(nation).cast("int").alias("platform_id"),
        F.concat(F.lit("cust"), key.cast("string"), F.lit("@mail.example")).alias("email"),
        F.col("c_mktsegment").alias("provider_name"),
        F.abs("c_acctbal").cast(MONEY).alias("cost"),
        F.when(key % 10 == 3, F.lit(None).cast("date"))
        .otherwise(_days(F.lit(as_of), key % 61 - 20))
        .alias("expiry_date"),
        _days(F.lit(dt.date(1995, 1, 1)), key % 700).alias("created_on"),
    )


def bind_profiles(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> DataFrame:
    o = read_source(
        spark,
        sf_dir,
        "orders",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    )
    key, holder = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("id"),
        F.when(holder % 10 == 7, holder - 1).otherwise(holder).alias("account_id"),
        F.concat(F.lit("P"), key.cast("string")).alias("profile_name"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(""))
        .otherwise(F.concat(F.lit("Client "), F.col("o_custkey").cast("string")))
        .alias("client_name"),
        F.when(key % 4 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("+54 (11) "), (F.lit(10000000) + key).cast("string")))
        .alias("client_whatsapp"),
        F.when(key % 25 == 0, F.lit(0).cast(MONEY)).otherwise(F.col("o_totalprice").cast(MONEY)).alias("sale_price"),
        F.when(key % 8 == 5, F.lit(None).cast("date"))
        .otherwise(_days(F.lit(as_of), key % 91 - 30))
        .alias("expiry_date"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def bind_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_source(
        spark,
        sf_dir,
        "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"],
    )
    o = read_source(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    c = read_source(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    is_acct = F.col("l_returnflag") == "A"
    lk, holder, nation = F.col("l_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    cust = F.col("o_custkey").cast("string")

    def profile_only(text: F.Column) -> F.Column:
        return F.when(is_acct, F.lit("")).otherwise(text)

    return j.select(
        F.when(is_acct, F.lit(None).cast("bigint")).when(lk % 9 == 0, -lk).otherwise(lk).alias("profile_id"),
        F.when(holder % 50 == 0, -holder).otherwise(holder).alias("account_id"),
        F.when(nation == 24, 99).otherwise(nation).cast("int").alias("platform_id"),
        F.concat(F.lit("old"), cust, F.lit("@mail.example")).alias("account_email"),
        F.concat(F.lit("Old "), F.col("c_nationkey").cast("string")).alias("platform_name"),
        profile_only(F.concat(F.lit("OldP"), lk.cast("string"))).alias("profile_name"),
        profile_only(F.concat(F.lit("Old Client "), cust)).alias("client_name"),
        profile_only(F.concat(F.lit("+54 9 "), (F.lit(20000000) + lk).cast("string"))).alias("client_whatsapp"),
        F.lit("o").alias("platform_icon"),
        F.lit("#ffffff").alias("platform_color"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("date"))
        .otherwise(F.to_date("o_orderdate"))
        .alias("old_expiry_date"),
        F.date_add(F.to_date("l_shipdate"), 30).alias("new_expiry_date"),
        F.when(F.col("l_linenumber") == 7, F.lit(0).cast(MONEY))
        .otherwise(F.col("l_extendedprice").cast(MONEY))
        .alias("sale_price"),
        F.when(is_acct, F.lit("account")).otherwise(F.lit("profile")).alias("renewal_type"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"),
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
    )


def bind_tables(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> Tables:
    """Lazy DataFrames for the four tables; nothing runs until an action."""
    return Tables(
        platforms=bind_platforms(spark, sf_dir),
        accounts=bind_accounts(spark, sf_dir, as_of),
        profiles=bind_profiles(spark, sf_dir, as_of),
        renewals=bind_renewals(spark, sf_dir),
    )
