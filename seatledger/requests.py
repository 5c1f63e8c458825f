"""Request batches for the registered change queries, built from the tables.

Each batch is derived from whole tables (every platform, account or profile
sends one or two requests, or every row that meets a business rule, such as
profiles without a client) so the work grows with the data. Each builder has
its DuckDB twin in SQL text (same rows) for the oracle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import MONEY, Tables

AS_OF = dt.date(2000, 1, 1)
NOW = dt.datetime(2000, 1, 1, 12, 0, 0)
NOW_SQL = "TIMESTAMP '2000-01-01 12:00:00'"
AS_OF_SQL = "DATE '2000-01-01'"
DUP = 1_000_000_000  # seq offset of a repeated request


def _twice(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))


# ----------------------------------------------------------------- inserts
def insert_platforms_req(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.platforms.select(
        i.cast("bigint").alias("seq"),
        F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.col("name"), F.lit(" Plus"))).alias("name"),
        F.when(i % 2 == 0, F.lit("")).otherwise(F.col("icon")).alias("icon"),
        F.lit("").alias("color"),
        (i % 3).cast("int").alias("max_profiles"),
    )


INSERT_PLATFORMS_REQ = """
SELECT CAST(id AS BIGINT) AS seq,
       CASE WHEN id % 5 = 0 THEN '' ELSE name || ' Plus' END AS name,
       CASE WHEN id % 2 = 0 THEN '' ELSE icon END AS icon,
       '' AS color, CAST(id % 3 AS INTEGER) AS max_profiles
FROM platforms
"""


def insert_accounts_req(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.accounts.select(
        i.alias("seq"),
        (F.col("platform_id") + 1).cast("int").alias("platform_id"),
        F.when(i % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("new"), F.col("email"))).alias("email"),
        F.when(i % 11 == 0, F.lit("")).otherwise(F.lit("pw")).alias("password"),
        "provider_name",
        "cost",
        "expiry_date",
    )


INSERT_ACCOUNTS_REQ = """
SELECT id AS seq, CAST(platform_id + 1 AS INTEGER) AS platform_id,
       CASE WHEN id % 7 = 0 THEN '' ELSE 'new' || email END AS email,
       CASE WHEN id % 11 = 0 THEN '' ELSE 'pw' END AS password,
       provider_name, cost, expiry_date
FROM accounts
"""


def insert_profiles_req(t: Tables) -> DataFrame:
    return t.profiles.select(
        F.col("id").alias("seq"),
        (F.col("account_id") + 1).alias("account_id"),
        F.concat(F.lit("N"), F.col("profile_name")).alias("profile_name"),
        "client_name",
        "client_whatsapp",
        "sale_price",
        "expiry_date",
    )


INSERT_PROFILES_REQ = """
SELECT id AS seq, account_id + 1 AS account_id, 'N' || profile_name AS profile_name,
       client_name, client_whatsapp, sale_price, expiry_date
FROM profiles
"""


# ----------------------------------------------------------------- updates
def update_platforms_req(t: Tables) -> DataFrame:
    d = _twice(t.platforms)
    i, k = F.col("id"), F.col("k")
    return d.select(
        (i * 2 + k).cast("bigint").alias("seq"),
        F.when((k == 1) & (i % 7 == 0), i + 1000).otherwise(i).cast("int").alias("id"),
        F.when((k == 1) & (i % 3 == 0), F.lit("")).otherwise(F.concat(F.col("name"), F.lit(" v"), k.cast("string"))).alias("name"),
        F.when(k == 0, F.lit("")).otherwise(F.col("icon")).alias("icon"),
        F.when(k == 1, F.lit("")).otherwise(F.col("color")).alias("color"),
        ((i + k) % 4).cast("int").alias("max_profiles"),
    )


UPDATE_PLATFORMS_REQ = """
SELECT CAST(id * 2 + k AS BIGINT) AS seq,
       CAST(CASE WHEN k = 1 AND id % 7 = 0 THEN id + 1000 ELSE id END AS INTEGER) AS id,
       CASE WHEN k = 1 AND id % 3 = 0 THEN '' ELSE name || ' v' || CAST(k AS VARCHAR) END AS name,
       CASE WHEN k = 0 THEN '' ELSE icon END AS icon,
       CASE WHEN k = 1 THEN '' ELSE color END AS color,
       CAST((id + k) % 4 AS INTEGER) AS max_profiles
FROM platforms, (VALUES (0), (1)) v(k)
"""


def update_accounts_req(t: Tables) -> DataFrame:
    d = _twice(t.accounts)
    i, k = F.col("id"), F.col("k")
    return d.select(
        (i * 2 + k).alias("seq"),
        "id",
        F.when((k == 1) & (i % 5 == 0), F.lit("")).otherwise(F.concat(F.lit("upd"), k.cast("string"), F.col("email"))).alias("email"),
        F.lit("pw").alias("password"),
        F.when(k == 0, F.lit("")).otherwise(F.col("provider_name")).alias("provider_name"),
        (F.col("cost") + k).cast(MONEY).alias("cost"),
        F.when((k == 1) & (i % 4 == 0), F.lit(None).cast("date")).otherwise(F.date_add(F.lit(AS_OF), k)).alias("expiry_date"),
    )


UPDATE_ACCOUNTS_REQ = f"""
SELECT id * 2 + k AS seq, id,
       CASE WHEN k = 1 AND id % 5 = 0 THEN '' ELSE 'upd' || CAST(k AS VARCHAR) || email END AS email,
       'pw' AS password,
       CASE WHEN k = 0 THEN '' ELSE provider_name END AS provider_name,
       CAST(cost + k AS DECIMAL(10,2)) AS cost,
       CASE WHEN k = 1 AND id % 4 = 0 THEN NULL ELSE {AS_OF_SQL} + CAST(k AS INTEGER) END AS expiry_date
FROM accounts, (VALUES (0), (1)) v(k)
"""


def update_profiles_req(t: Tables) -> DataFrame:
    d = _twice(t.profiles)
    i, k = F.col("id"), F.col("k")
    return d.select(
        (i * 2 + k).alias("seq"),
        "id",
        F.concat(F.col("profile_name"), F.lit("-"), k.cast("string")).alias("profile_name"),
        F.when(k == 1, F.col("client_name")).otherwise(F.lit("Someone")).alias("client_name"),
        F.when(k == 1, F.lit("")).otherwise(F.col("client_whatsapp")).alias("client_whatsapp"),
        F.when(k == 1, F.lit(None).cast(MONEY)).otherwise(F.col("sale_price")).alias("sale_price"),
        F.when(k == 1, F.lit(None).cast("date")).otherwise(F.date_add(F.lit(AS_OF), 10)).alias("expiry_date"),
    )


UPDATE_PROFILES_REQ = f"""
SELECT id * 2 + k AS seq, id,
       profile_name || '-' || CAST(k AS VARCHAR) AS profile_name,
       CASE WHEN k = 1 THEN client_name ELSE 'Someone' END AS client_name,
       CASE WHEN k = 1 THEN '' ELSE client_whatsapp END AS client_whatsapp,
       CASE WHEN k = 1 THEN NULL ELSE sale_price END AS sale_price,
       CASE WHEN k = 1 THEN NULL ELSE {AS_OF_SQL} + 10 END AS expiry_date
FROM profiles, (VALUES (0), (1)) v(k)
"""


def merge_profiles_req(t: Tables) -> DataFrame:
    d = _twice(t.profiles)
    i, k = F.col("id"), F.col("k")
    return d.select(
        (i * 2 + k).alias("seq"),
        (i + F.when(k == 1, F.lit(7)).otherwise(F.lit(0))).alias("id"),
        F.when(k == 0, F.concat(F.lit("M"), F.col("profile_name"))).alias("profile_name"),
        F.when(k == 1, F.lit("Merged")).alias("client_name"),
        F.lit(None).cast("string").alias("client_whatsapp"),
        F.when(k == 0, F.col("sale_price") + 1).cast(MONEY).alias("sale_price"),
        F.when(k == 1, F.date_add(F.lit(AS_OF), 5)).alias("expiry_date"),
    )


MERGE_PROFILES_REQ = f"""
SELECT id * 2 + k AS seq, id + CASE WHEN k = 1 THEN 7 ELSE 0 END AS id,
       CASE WHEN k = 0 THEN 'M' || profile_name END AS profile_name,
       CASE WHEN k = 1 THEN 'Merged' END AS client_name,
       CAST(NULL AS VARCHAR) AS client_whatsapp,
       CAST(CASE WHEN k = 0 THEN sale_price + 1 END AS DECIMAL(10,2)) AS sale_price,
       CASE WHEN k = 1 THEN {AS_OF_SQL} + 5 END AS expiry_date
FROM profiles, (VALUES (0), (1)) v(k)
"""


# ----------------------------------------------------------------- deletes
def soft_delete_req(t: Tables) -> DataFrame:
    """Every profile without a client, asked twice (the repeat is rejected)."""
    base = t.profiles.where(F.col("client_name") == "").select("id")
    d = _twice(base)
    return d.select((F.col("id") + F.col("k") * DUP).alias("seq"), "id")


SOFT_DELETE_REQ = f"""
SELECT id + k * {DUP} AS seq, id FROM profiles, (VALUES (0), (1)) v(k) WHERE client_name = ''
"""


def delete_accounts_req(t: Tables) -> DataFrame:
    """Every account of one provider, plus the accounts of a missing one."""
    base = t.accounts.where(F.col("provider_name") == "BUILDING").select("id")
    return _twice(base).select((F.col("id") + F.col("k") * DUP).alias("seq"), "id")


DELETE_ACCOUNTS_REQ = f"""
SELECT id + k * {DUP} AS seq, id FROM accounts, (VALUES (0), (1)) v(k) WHERE provider_name = 'BUILDING'
"""


def delete_platforms_req(t: Tables) -> DataFrame:
    """Every platform with the smallest plan (4 profiles), asked twice."""
    base = t.platforms.where(F.col("max_profiles") == 4).select("id")
    return _twice(base).select((F.col("id") + F.col("k") * DUP).cast("bigint").alias("seq"), "id")


DELETE_PLATFORMS_REQ = f"""
SELECT CAST(id + k * {DUP} AS BIGINT) AS seq, id FROM platforms, (VALUES (0), (1)) v(k) WHERE max_profiles = 4
"""


# ---------------------------------------------------------------- renewals
def renew_profiles_req(t: Tables) -> DataFrame:
    """Every profile renews twice: +30 and +60 days from its date (or today)."""
    d = _twice(t.profiles)
    i, k = F.col("id"), F.col("k")
    base = F.coalesce(F.col("expiry_date"), F.lit(AS_OF))
    return d.select(
        (i * 2 + k).alias("seq"),
        i.alias("profile_id"),
        F.date_add(base, (k + 1) * 30).alias("new_expiry_date"),
        F.when(k == 0, F.col("sale_price")).cast(MONEY).alias("sale_price"),
    )


RENEW_PROFILES_REQ = f"""
SELECT id * 2 + k AS seq, id AS profile_id,
       COALESCE(expiry_date, {AS_OF_SQL}) + CAST((k + 1) * 30 AS INTEGER) AS new_expiry_date,
       CAST(CASE WHEN k = 0 THEN sale_price END AS DECIMAL(10,2)) AS sale_price
FROM profiles, (VALUES (0), (1)) v(k)
"""


def renew_accounts_req(t: Tables) -> DataFrame:
    d = _twice(t.accounts)
    i, k = F.col("id"), F.col("k")
    return d.select(
        (i * 2 + k).alias("seq"),
        i.alias("account_id"),
        F.date_add(F.lit(AS_OF), (k + 1) * 30).alias("new_expiry_date"),
        F.when(k == 0, F.col("cost")).cast(MONEY).alias("renewal_cost"),
    )


RENEW_ACCOUNTS_REQ = f"""
SELECT id * 2 + k AS seq, id AS account_id,
       {AS_OF_SQL} + CAST((k + 1) * 30 AS INTEGER) AS new_expiry_date,
       CAST(CASE WHEN k = 0 THEN cost END AS DECIMAL(10,2)) AS renewal_cost
FROM accounts, (VALUES (0), (1)) v(k)
"""


def target_days_req(t: Tables) -> DataFrame:
    """Every profile asks for 30 days; every tenth asks for 0 (rejected)."""
    i = F.col("id")
    return t.profiles.select(i.alias("seq"), "id", F.when(i % 10 == 0, F.lit(0)).otherwise(F.lit(30)).alias("days"))


TARGET_DAYS_REQ = """
SELECT id AS seq, id, CASE WHEN id % 10 = 0 THEN 0 ELSE 30 END AS days FROM profiles
"""


# ------------------------------------------------- requests of every kind in one batch
PHASE = 10_000_000_000  # seq of a phase: its number times this, then 16 for each id, then a slot for each table


def _seq(phase: int, slot: int):
    return (F.lit(phase * PHASE + slot) + F.col("id").cast("bigint") * 16).alias("seq")


def replay_req(t: Tables) -> DataFrame:
    """A day of every business: renewals, edits, deletions and insertions of all rows, in phases.

    Every profile is renewed to a date, some are edited, renewed by days or deleted, and all are
    renewed again; accounts and platforms are edited, renewed and deleted in between, and
    new rows are inserted and renewed.
    """
    i, day = F.col("id"), lambda n: F.date_add(F.lit(AS_OF), n)
    base = F.coalesce(F.col("expiry_date"), F.lit(AS_OF))
    word = lambda c, w: F.concat(F.col(c), F.lit(w))
    days = lambda n: (F.lit(n) if isinstance(n, int) else n).cast("int").alias("days")
    price = lambda c: F.col(c).cast(MONEY).alias("price")
    own = lambda table, kind, phase, slot, *fields, where=F.lit(True): table.where(where).select(_seq(phase, slot), F.lit(kind).alias("kind"), *fields)
    pr, ac, pl = t.profiles, t.accounts, t.platforms
    own_id = i.cast("bigint").alias("id")
    profile_edit = [
        word("profile_name", " v2").alias("name"),
        F.when(i % 6 == 0, F.lit("")).otherwise(word("client_name", " jr")).alias("client_name"),
        "client_whatsapp",
        (F.col("sale_price") + 1).cast(MONEY).alias("price"),
        F.when(i % 12 != 3, day((i % 20 - 10).cast("int"))).alias("expiry_date"),
    ]
    account_edit = [
        F.concat(F.lit("u"), "email").alias("email"), F.lit("pw").alias("password"), "provider_name", (F.col("cost") + 1).cast(MONEY).alias("cost"), day(5).alias("expiry_date"),
    ]
    sixth = i % 6 == 0
    # the id that a phase 7 insert into the account gets
    top = F.coalesce(t.profiles.select(F.max("id")).scalar(), F.lit(0))
    low = t.profiles.select(F.min("id")).scalar() * 16 + PHASE
    inserted = (top + F.lit(7 * PHASE + 1) + i * 16 - low + 1).cast("bigint").alias("id")
    parts = [
        own(pr, "renew_profile", 1, 0, own_id, F.date_add(base, 30).alias("expiry_date"), price("sale_price")),
        own(pr, "update_profile", 2, 0, own_id, *profile_edit, where=i % 3 == 0),
        own(ac, "update_account", 2, 1, own_id, *account_edit, where=i % 4 == 0),
        own(ac, "renew_account", 2, 4, own_id, day(40).alias("expiry_date"), price("cost"), where=i % 5 == 0),
        own(pr, "renew_profile", 3, 0, own_id, days(i % 10), where=i % 2 == 0),
        own(pl, "update_platform", 3, 2, own_id, word("name", " 2").alias("name"), F.lit("").alias("icon"), "color", F.lit(3).alias("max_profiles"), where=i % 3 == 0),
        own(pr, "delete_profile", 4, 0, own_id, where=i % 7 == 0),
        own(ac, "delete_account", 4, 1, own_id, where=i % 11 == 0),
        own(pr, "renew_profile", 5, 0, own_id, days(15)),
        own(ac, "renew_account", 5, 1, own_id, days(20), where=i % 2 == 0),
        own(pl, "delete_platform", 6, 2, own_id, where=i % 8 == 1),
        own(ac, "insert_profile", 7, 1, own_id.alias("parent_id"), F.lit("NP").alias("name"), F.lit("NC").alias("client_name"), F.lit(9).cast(MONEY).alias("price"), day(3).alias("expiry_date"), where=sixth),
        own(pl, "insert_account", 7, 2, own_id.alias("parent_id"), F.concat(F.lit("n"), "name").alias("email"), F.lit("pw").alias("password")),
        own(pl, "insert_platform", 1, 3, F.when(i % 5 != 0, word("name", " new")).alias("name")),
        own(ac, "renew_profile", 8, 0, inserted, days(30), where=sixth),
        own(ac, "renew_account", 8, 1, own_id, day(90).alias("expiry_date"), where=i % 9 == 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _replay_sql() -> str:
    columns = (
        ("id", "BIGINT"), ("parent_id", "BIGINT"), ("name", "VARCHAR"), ("icon", "VARCHAR"), ("color", "VARCHAR"), ("max_profiles", "INTEGER"), ("email", "VARCHAR"),
        ("password", "VARCHAR"), ("provider_name", "VARCHAR"), ("cost", "DECIMAL(10,2)"), ("client_name", "VARCHAR"), ("client_whatsapp", "VARCHAR"),
        ("price", "DECIMAL(10,2)"), ("expiry_date", "DATE"), ("days", "INTEGER"),
    )

    def own(table: str, kind: str, phase: int, slot: int, where: str = "true", **fields: str) -> str:
        given = ", ".join(f"CAST({fields.get(c, 'NULL')} AS {k}) AS {c}" for c, k in columns)
        return f"SELECT CAST({phase * PHASE + slot} + CAST(id AS BIGINT) * 16 AS BIGINT) AS seq, '{kind}' AS kind, {given} FROM {table} WHERE {where}"

    day = lambda n: f"{AS_OF_SQL} + CAST({n} AS INTEGER)"
    inserted = f"(SELECT max(id) FROM profiles) + {7 * PHASE + 1} + id * 16 - ((SELECT min(id) FROM profiles) * 16 + {PHASE}) + 1"
    return " UNION ALL ".join(
        [
            own("profiles", "renew_profile", 1, 0, id="id", expiry_date=f"COALESCE(expiry_date, {AS_OF_SQL}) + 30", price="sale_price"),
            own("profiles", "update_profile", 2, 0, "id % 3 = 0", id="id", name="profile_name || ' v2'", client_name="CASE WHEN id % 6 = 0 THEN '' ELSE client_name || ' jr' END",
                client_whatsapp="client_whatsapp", price="sale_price + 1", expiry_date=f"CASE WHEN id % 12 <> 3 THEN {day('id % 20 - 10')} END"),
            own("accounts", "update_account", 2, 1, "id % 4 = 0", id="id", email="'u' || email", password="'pw'", provider_name="provider_name", cost="cost + 1", expiry_date=day(5)),
            own("accounts", "renew_account", 2, 4, "id % 5 = 0", id="id", expiry_date=day(40), price="cost"),
            own("profiles", "renew_profile", 3, 0, "id % 2 = 0", id="id", days="id % 10"),
            own("platforms", "update_platform", 3, 2, "id % 3 = 0", id="id", name="name || ' 2'", icon="''", color="color", max_profiles="3"),
            own("profiles", "delete_profile", 4, 0, "id % 7 = 0", id="id"),
            own("accounts", "delete_account", 4, 1, "id % 11 = 0", id="id"),
            own("profiles", "renew_profile", 5, 0, id="id", days="15"),
            own("accounts", "renew_account", 5, 1, "id % 2 = 0", id="id", days="20"),
            own("platforms", "delete_platform", 6, 2, "id % 8 = 1", id="id"),
            own("accounts", "insert_profile", 7, 1, "id % 6 = 0", parent_id="id", name="'NP'", client_name="'NC'", price="9", expiry_date=day(3)),
            own("platforms", "insert_account", 7, 2, parent_id="id", email="'n' || name", password="'pw'"),
            own("platforms", "insert_platform", 1, 3, name="CASE WHEN id % 5 <> 0 THEN name || ' new' END"),
            own("accounts", "renew_profile", 8, 0, "id % 6 = 0", id=inserted, days="30"),
            own("accounts", "renew_account", 8, 1, "id % 9 = 0", id="id", expiry_date=day(90)),
        ]
    )


REPLAY_REQ = _replay_sql()


def admission_req(t: Tables) -> DataFrame:
    """Every profile's account gets two inserts; in between, every third profile is released, and
    later the first insert of every fifth (whether or not it was admitted)."""
    i = F.col("id")
    top, low = t.profiles.select(F.max("id")).scalar(), t.profiles.select(F.min("id")).scalar() * 4
    d = t.profiles.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    k = F.col("k")
    d = d.where(((k == 1) & (i % 3 == 0)) | ((k == 3) & (i % 5 == 0)) | (k % 2 == 0))
    insert = k % 2 == 0
    return d.select(
        (i * 4 + k).cast("bigint").alias("seq"),
        F.when(insert, F.lit("insert_profile")).otherwise(F.lit("delete_profile")).alias("kind"),
        F.when(k == 1, i).when(k == 3, top + i * 4 - low + 1).cast("bigint").alias("id"),
        F.when(insert, F.col("account_id")).alias("account_id"),
        F.when(insert, F.concat(F.lit("N"), "profile_name")).alias("profile_name"),
        F.when(insert, F.col("client_name")).alias("client_name"),
        "sale_price",
    )


ADMISSION_REQ = """
SELECT CAST(id * 4 + k AS BIGINT) AS seq, CASE WHEN k % 2 = 0 THEN 'insert_profile' ELSE 'delete_profile' END AS kind,
       CAST(CASE k WHEN 1 THEN id WHEN 3 THEN (SELECT max(id) FROM profiles) + id * 4 - (SELECT min(id) FROM profiles) * 4 + 1 END AS BIGINT) AS id,
       CASE WHEN k % 2 = 0 THEN account_id END AS account_id, CASE WHEN k % 2 = 0 THEN 'N' || profile_name END AS profile_name,
       CASE WHEN k % 2 = 0 THEN client_name END AS client_name, sale_price
FROM profiles, (VALUES (0), (1), (2), (3)) v(k)
WHERE k % 2 = 0 OR (k = 1 AND id % 3 = 0) OR (k = 3 AND id % 5 = 0)
"""


def renew_some_accounts_req(t: Tables) -> DataFrame:
    """Every account renews; every third without a date, every fifth under an id that is not there."""
    i = F.col("id")
    return t.accounts.select(
        i.alias("seq"),
        F.when(i % 5 == 0, -i).otherwise(i).alias("account_id"),
        F.when(i % 3 != 0, F.date_add(F.lit(AS_OF), 30)).alias("new_expiry_date"),
        F.col("cost").cast(MONEY).alias("renewal_cost"),
    )


RENEW_SOME_ACCOUNTS_REQ = f"""
SELECT id AS seq, CASE WHEN id % 5 = 0 THEN -id ELSE id END AS account_id,
       CASE WHEN id % 3 <> 0 THEN {AS_OF_SQL} + 30 END AS new_expiry_date, CAST(cost AS DECIMAL(10,2)) AS renewal_cost
FROM accounts
"""
