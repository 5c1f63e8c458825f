"""Change batches: the single-row writes of the original, applied set-wise.

Each operator takes the current ``Tables`` and a DataFrame of requests with a
``seq`` column (one kind of change per batch; requests on the same key take
effect in ``seq`` order, as if sent one by one) and returns a
``ChangeResult``: new tables, the rows written, and the rejected requests
with a reason. Nothing is mutated; persisting the new tables is the caller's
choice (see ``sources.tables.write_tables``).

Last-write-wins uses ``max_by(..., seq)`` aggregates (partial aggregation, so
a key with many requests is combined map-side); ordered effects within a key
use ``plans.sequence`` (bounded window groups).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..model import (
    DEFAULT_COLOR,
    DEFAULT_ICON,
    DEFAULT_MAX_PROFILES,
    LOG_PARTITION,
    MONEY,
    RENEWAL_ACCOUNT,
    RENEWAL_PROFILE,
    Tables,
    empty_like,
    ntz,
)
from ..plans.joins import DIMENSION_MAX_ROWS, left_join_spread_nulls, matching, restrict_to_keys, small_enough
from ..plans.sequence import previous_in_key, rank_in_key
from ..sources.tables import stage
from .reports import _accounts_with_platform
from .rollups import profiles_per_account

# Reasons given to rejected requests.
MISSING_FIELD = "missing_field"
NOT_FOUND = "not_found"
PARENT_NOT_FOUND = "parent_not_found"
ACCOUNT_FULL = "account_full"
BAD_DAYS = "invalid_days"

PHONE = "provider_phone"  # an account column that only some deployments keep


@dataclass(frozen=True)
class ChangeResult:
    """The tables after a change, the rows written and the requests rejected.
    ``appended``: by table, rows that were only added (``commit_changes``
    writes those beside the old ones instead of the whole table). ``changed``: by
    table, the rows that a change took out and put in, where it knows them
    (``increments.fold`` adds those to stored rollups)."""

    tables: Tables
    applied: DataFrame
    rejected: DataFrame
    appended: dict[str, DataFrame] = field(default_factory=dict)
    changed: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)


# ----------------------------------------------------------------- helpers
def text_or(c: str, default: str) -> Column:
    """F6 for text: null or blank takes the default."""
    col = F.col(c)
    return F.when(col.isNull() | (col == F.lit("")), F.lit(default)).otherwise(col)


def number_or(c: str, default, dtype) -> Column:
    """F6 for numbers: null or 0 takes the default (0 is falsy)."""
    col = F.col(c)
    return F.when(col.isNull() | (col == F.lit(0)), F.lit(default)).otherwise(col).cast(dtype)


def _opt(req: DataFrame, name: str, dtype: str) -> Column:
    """A request column, or a typed null when the batch does not carry it."""
    return F.col(name).cast(dtype) if name in req.columns else F.lit(None).cast(dtype)


def _filled(req: DataFrame, name: str, default, dtype=None) -> Column:
    """A request column with its default (F6), also where the batch does not carry it."""
    if name not in req.columns:
        return F.lit(default).cast(dtype or "string").alias(name)
    return (text_or(name, default) if dtype is None else number_or(name, default, dtype)).alias(name)


def truthy(req: DataFrame, name: str) -> Column:
    """P12 for one request field: null, blank text and numeric 0 are falsy."""
    if name not in req.columns:
        return F.lit(False)
    dtype = req.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != F.lit(0))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return P.required(name)


def _need(req: DataFrame, *names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & truthy(req, n)
    return cond


def _split(req: DataFrame, reason: Column, checkpoint: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tag each request with a reason (null = accepted) and split.

    With ``checkpoint`` the tagged requests (already joined to the live rows
    they change) are written once as Parquet to the shared checkpoint folder
    (``stage``), so the
    several outputs of a change (log rows, new table, rejections) read them
    instead of repeating the join, and a lost executor does not recompute it.
    """
    tagged = req.withColumn("reason", reason)
    if checkpoint:
        tagged = stage(tagged, "requests")
    ok = tagged.where(F.col("reason").isNull()).drop("reason")
    bad = tagged.where(F.col("reason").isNotNull())
    return ok, bad


def _exists(req: DataFrame, fk: str, parent: DataFrame, flag: str = "__found") -> DataFrame:
    """Left join a presence flag of ``parent.id`` on ``req.fk`` (ids are unique).

    Requests without a key (invalid anyway) are spread, not sent to one task;
    the parents of a small batch are picked without shuffling the table.
    """
    keys = matching(parent.select(F.col("id").alias(fk), F.lit(True).alias(flag)), fk, req, fk, small_enough(req))
    return left_join_spread_nulls(req, keys, fk, fk, salt_cols=["seq"])


def new_ids(existing: DataFrame, req: DataFrame) -> Column:
    """Serial-like ids without a global window: max(id) + (seq - min(seq)) + 1.

    Unique because ``seq`` is; not dense (rejected requests leave gaps, as a
    database sequence may). Both bounds are scalar subqueries.
    """
    top = F.coalesce(existing.select(F.max("id")).scalar(), F.lit(0)).cast("bigint")
    low = req.select(F.min("seq")).scalar().cast("bigint")
    return top + (F.col("seq").cast("bigint") - low) + F.lit(1)


# ----------------------------------------------------------------- inserts
def insert_platforms(t: Tables, req: DataFrame, as_of: dt.date) -> ChangeResult:
    """Name required; icon, color, max_profiles default when falsy."""
    ok, bad = _split(req, F.when(~_need(req, "name"), F.lit(MISSING_FIELD)))
    new = ok.select(
        new_ids(t.platforms, req).cast("int").alias("id"),
        F.col("name"),
        text_or("icon", DEFAULT_ICON).alias("icon") if "icon" in req.columns else F.lit(DEFAULT_ICON).alias("icon"),
        text_or("color", DEFAULT_COLOR).alias("color") if "color" in req.columns else F.lit(DEFAULT_COLOR).alias("color"),
        (number_or("max_profiles", DEFAULT_MAX_PROFILES, "int") if "max_profiles" in req.columns else F.lit(DEFAULT_MAX_PROFILES))
        .cast("int")
        .alias("max_profiles"),
        F.lit(as_of).alias("created_on"),
    )
    return ChangeResult(t.with_(platforms=t.platforms.unionByName(new)), new, bad, {"platforms": new})


def insert_accounts(t: Tables, req: DataFrame, as_of: dt.date) -> ChangeResult:
    """Platform, email and password required; the platform must exist."""
    r = _exists(req, "platform_id", t.platforms)
    reason = F.when(~_need(req, "platform_id", "email", "password"), F.lit(MISSING_FIELD)).when(
        F.col("__found").isNull(), F.lit(PARENT_NOT_FOUND)
    )
    ok, bad = _split(r, reason)
    new = ok.select(
        new_ids(t.accounts, req).alias("id"),
        F.col("platform_id").cast("int"),
        F.col("email"),
        text_or("provider_name", "").alias("provider_name") if "provider_name" in req.columns else F.lit("").alias("provider_name"),
        (number_or("cost", 0, MONEY) if "cost" in req.columns else F.lit(0).cast(MONEY)).alias("cost"),
        _opt(req, "expiry_date", "date").alias("expiry_date"),
        F.lit(as_of).alias("created_on"),
        *([_filled(req, PHONE, "")] if PHONE in t.accounts.columns else []),
    )
    return ChangeResult(t.with_(accounts=t.accounts.unionByName(new)), new, bad.drop("__found"), {"accounts": new})


def insert_profiles(t: Tables, req: DataFrame, now: dt.datetime, enforce_capacity: bool = False) -> ChangeResult:
    """Account, profile name and client name required; account must exist.

    With ``enforce_capacity`` (C10, a rule of the older code) an insert is
    rejected once the account's active profiles reach the platform's
    max_profiles, counting earlier inserts of the same batch.
    """
    r = _exists(req, "account_id", t.accounts)
    reason = F.when(~_need(req, "account_id", "profile_name", "client_name"), F.lit(MISSING_FIELD)).when(
        F.col("__found").isNull(), F.lit(PARENT_NOT_FOUND)
    )
    ok, bad = _split(r, reason)
    ok = ok.drop("__found")
    bad = bad.drop("__found")
    if enforce_capacity:
        ok, full = admit_within_capacity(t, ok)
        bad = bad.unionByName(full, allowMissingColumns=True)
    new = ok.select(
        new_ids(t.profiles, req).alias("id"),
        F.col("account_id").cast("bigint"),
        F.col("profile_name"),
        F.col("client_name"),
        text_or("client_whatsapp", "").alias("client_whatsapp")
        if "client_whatsapp" in req.columns
        else F.lit("").alias("client_whatsapp"),
        (number_or("sale_price", 0, MONEY) if "sale_price" in req.columns else F.lit(0).cast(MONEY)).alias("sale_price"),
        _opt(req, "expiry_date", "date").alias("expiry_date"),
        F.lit(True).alias("is_active"),
        ntz(now).alias("created_at"),
    )
    return ChangeResult(t.with_(profiles=t.profiles.unionByName(new)), new, bad, {"profiles": new})


def admit_within_capacity(t: Tables, req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admit inserts while active profiles + earlier admitted < max_profiles.

    Returns (admitted, rejected). The position of each request within its
    account is computed without a per-account window group.
    """
    # only the batch's accounts are counted when that key set is small
    mine = restrict_to_keys(t.profiles, "account_id", req, "account_id")
    active = profiles_per_account(mine).select(F.col("account_id"), F.col("n_active"))
    cap = t.accounts.select(F.col("id").alias("account_id"), "platform_id").join(
        t.platforms.select(F.col("id").alias("platform_id"), "max_profiles"), "platform_id"
    )
    r = rank_in_key(req, "account_id", "seq", "__pos")
    r = r.join(cap.select("account_id", "max_profiles"), "account_id", "left").join(active, "account_id", "left")
    room = F.col("max_profiles") - F.coalesce(F.col("n_active"), F.lit(0))
    ok, bad = _split(r, F.when(F.col("__pos") > room, F.lit(ACCOUNT_FULL)))
    drop = ["__pos", "max_profiles", "n_active"]
    return ok.drop(*drop), bad.drop(*drop)


# ----------------------------------------------------------------- updates
def _last_valid(ok: DataFrame, fields: list[str], keep_on_null: list[str] = ()) -> DataFrame:
    """One row per id: the last request's fields (by seq); for ``keep_on_null``
    fields the last non-null value (null when every request left it blank)."""
    aggs = [F.max_by(F.struct(*[F.col(f).alias(f) for f in fields]), "seq").alias("__w"), F.max("seq").alias("seq")]
    for f in keep_on_null:
        aggs.append(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias("__keep_" + f))
    g = ok.groupBy("id").agg(*aggs)
    cols = [F.col("id"), F.col("seq")] + [F.col("__w." + f).alias(f) for f in fields if f not in keep_on_null]
    cols += [F.col("__keep_" + f).alias(f) for f in keep_on_null]
    return g.select(*cols)


def _overwrite(table: DataFrame, winners: DataFrame, req: DataFrame, fields: list[str], keep_on_null: list[str] = ()) -> DataFrame:
    """Replace ``fields`` of matched rows; ``keep_on_null`` fall back to the old value."""
    w = winners.select(F.col("id"), F.lit(True).alias("__hit"), *[F.col(f).alias("__new_" + f) for f in fields])
    # few new rows (no more than requests) go to the table's tasks; the table itself is not shuffled
    j = table.join(F.broadcast(w) if small_enough(req, DIMENSION_MAX_ROWS) else w, "id", "left")
    out = []
    for c in table.columns:
        if c in fields:
            new = F.col("__new_" + c)
            if c in keep_on_null:
                new = F.coalesce(new, F.col(c))
            out.append(F.when(F.col("__hit"), new).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def update_platforms(t: Tables, req: DataFrame) -> ChangeResult:
    """Full overwrite of name, icon, color, max_profiles (with defaults)."""
    r = _exists(req, "id", t.platforms)
    ok, bad = _split(
        r,
        F.when(~_need(req, "name"), F.lit(MISSING_FIELD)).when(F.col("__found").isNull(), F.lit(NOT_FOUND)),
    )
    ok = ok.select(
        "seq",
        F.col("id").cast("int").alias("id"),
        "name",
        _filled(req, "icon", DEFAULT_ICON),
        _filled(req, "color", DEFAULT_COLOR),
        _filled(req, "max_profiles", DEFAULT_MAX_PROFILES, "int"),
    )
    fields = ["name", "icon", "color", "max_profiles"]
    win = _last_valid(ok, fields)
    return ChangeResult(t.with_(platforms=_overwrite(t.platforms, win, req, fields)), win, bad.drop("__found"))


def update_accounts(t: Tables, req: DataFrame, keep_expiry_on_blank: bool = False) -> ChangeResult:
    """Overwrite email, provider_name, cost, expiry_date; email and password required.

    ``keep_expiry_on_blank`` (C3): an edit with a blank date keeps the old one.
    """
    r = _exists(req, "id", t.accounts)
    ok, bad = _split(
        r,
        F.when(~_need(req, "email", "password"), F.lit(MISSING_FIELD)).when(F.col("__found").isNull(), F.lit(NOT_FOUND)),
    )
    ok = ok.select(
        "seq",
        F.col("id").cast("bigint").alias("id"),
        "email",
        _filled(req, "provider_name", ""),
        _filled(req, "cost", 0, MONEY),
        _opt(req, "expiry_date", "date").alias("expiry_date"),
        *([_filled(req, PHONE, "")] if PHONE in t.accounts.columns else []),
    )
    fields = ["email", "provider_name", "cost", "expiry_date", *([PHONE] if PHONE in t.accounts.columns else [])]
    keep = ["expiry_date"] if keep_expiry_on_blank else []
    win = _last_valid(ok, fields, keep)
    return ChangeResult(t.with_(accounts=_overwrite(t.accounts, win, req, fields, keep)), win, bad.drop("__found"))


def update_profiles(t: Tables, req: DataFrame, keep_expiry_on_blank: bool = False) -> ChangeResult:
    """Full overwrite of an active profile; profile and client name required."""
    r = _exists(req, "id", t.profiles.where(P.is_active()))
    ok, bad = _split(
        r,
        F.when(~_need(req, "profile_name", "client_name"), F.lit(MISSING_FIELD)).when(
            F.col("__found").isNull(), F.lit(NOT_FOUND)
        ),
    )
    ok = ok.select(
        "seq",
        F.col("id").cast("bigint").alias("id"),
        "profile_name",
        "client_name",
        _filled(req, "client_whatsapp", ""),
        _filled(req, "sale_price", 0, MONEY),
        _opt(req, "expiry_date", "date").alias("expiry_date"),
    )
    fields = ["profile_name", "client_name", "client_whatsapp", "sale_price", "expiry_date"]
    keep = ["expiry_date"] if keep_expiry_on_blank else []
    win = _last_valid(ok, fields, keep)
    return ChangeResult(t.with_(profiles=_overwrite(t.profiles, win, req, fields, keep)), win, bad.drop("__found"))


def merge_profiles(t: Tables, req: DataFrame) -> ChangeResult:
    """C11: update only the supplied (non-null) fields of an existing profile."""
    r = _exists(req, "id", t.profiles)
    ok, bad = _split(r, F.when(F.col("__found").isNull(), F.lit(NOT_FOUND)))
    fields = [f for f in ["profile_name", "client_name", "client_whatsapp", "sale_price", "expiry_date"] if f in req.columns]
    ok = ok.select("seq", F.col("id").cast("bigint").alias("id"), *fields)
    win = _last_valid(ok, fields, fields)
    return ChangeResult(t.with_(profiles=_overwrite(t.profiles, win, req, fields, fields)), win, bad.drop("__found"))


# ----------------------------------------------------------------- deletes
def _first_hits(req: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first request per existing target id is applied; the rest rejected."""
    first = req.groupBy("id").agg(F.min("seq").alias("seq"))
    hits = first.join(matching(targets.select("id"), "id", req, "id", small_enough(req)), "id", "left_semi")
    bad = req.join(hits.select("id", "seq"), ["id", "seq"], "left_anti").withColumn("reason", F.lit(NOT_FOUND))
    return hits, bad


def soft_delete_profiles(t: Tables, req: DataFrame) -> ChangeResult:
    """C4: is_active := false for active profiles; others rejected."""
    req = req.select("seq", F.col("id").cast("bigint").alias("id"))
    hits, bad = _first_hits(req, t.profiles.where(P.is_active()))
    j = t.profiles.join(hits.select("id", F.lit(True).alias("__hit")), "id", "left")
    cols = [F.when(F.col("__hit"), F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_active" else F.col(c) for c in t.profiles.columns]
    return ChangeResult(t.with_(profiles=j.select(*cols)), hits, bad)


def delete_accounts(t: Tables, req: DataFrame) -> ChangeResult:
    """Delete accounts and, by cascade, their profiles; renewals stay."""
    req = req.select("seq", F.col("id").cast("bigint").alias("id"))
    hits, bad = _first_hits(req, t.accounts)
    gone = hits.select("id")
    accounts = t.accounts.join(gone, "id", "left_anti").select(*t.accounts.columns)
    profiles = t.profiles.join(gone.withColumnRenamed("id", "account_id"), "account_id", "left_anti").select(*t.profiles.columns)
    return ChangeResult(t.with_(accounts=accounts, profiles=profiles), hits, bad)


def delete_platforms(t: Tables, req: DataFrame) -> ChangeResult:
    """Delete platforms, their accounts and those accounts' profiles."""
    req = req.select("seq", F.col("id").cast("int").alias("id"))
    hits, bad = _first_hits(req, t.platforms)
    gone = hits.select(F.col("id").alias("platform_id"))
    platforms = t.platforms.join(hits.select("id"), "id", "left_anti").select(*t.platforms.columns)
    gone_accounts = t.accounts.join(gone, "platform_id", "left_semi").select(F.col("id").alias("account_id"))
    accounts = t.accounts.join(gone, "platform_id", "left_anti").select(*t.accounts.columns)
    profiles = t.profiles.join(gone_accounts, "account_id", "left_anti").select(*t.profiles.columns)
    return ChangeResult(t.with_(platforms=platforms, accounts=accounts, profiles=profiles), hits, bad)


def reset_data(t: Tables) -> Tables:
    """Empty renewals, profiles and accounts; platforms are kept."""
    return t.with_(accounts=empty_like(t.accounts), profiles=empty_like(t.profiles), renewals=empty_like(t.renewals))


def reset_report(before: Tables, after: Tables) -> DataFrame:
    """What a reset did: rows per table before and after, one row per table.

    One pass per table: each row counts 1 on its side, the union is summed
    per table name (partial aggregation, no join).
    """
    parts = []
    for name in ("platforms", "accounts", "profiles", "renewals"):
        for side, frame in (("rows_before", getattr(before, name)), ("rows_after", getattr(after, name))):
            parts.append(
                frame.select(
                    F.lit(name).alias("table_name"),
                    F.lit(1 if side == "rows_before" else 0).alias("rows_before"),
                    F.lit(1 if side == "rows_after" else 0).alias("rows_after"),
                )
            )
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    names = F.array(*[F.lit(n) for n in ("platforms", "accounts", "profiles", "renewals")])
    g = u.groupBy("table_name").agg(
        F.sum("rows_before").cast("bigint").alias("rows_before"), F.sum("rows_after").cast("bigint").alias("rows_after")
    )
    # a table empty on both sides still gets its row
    allnames = before.platforms.sparkSession.range(1).select(F.explode(names).alias("table_name"))
    return allnames.join(g, "table_name", "left").select(
        "table_name",
        F.coalesce(F.col("rows_before"), F.lit(0)).cast("bigint").alias("rows_before"),
        F.coalesce(F.col("rows_after"), F.lit(0)).cast("bigint").alias("rows_after"),
    )


# ---------------------------------------------------------------- renewals
def _log_rows(rows: DataFrame, renewals: DataFrame) -> DataFrame:
    """Shape new log rows like the log (extra log columns become null; the
    month partition column, when the log has one, is derived, and so is its id)."""
    cols = []
    for f in renewals.schema.fields:
        if f.name == LOG_PARTITION:
            c = F.date_format("created_at", "yyyy-MM")
        elif f.name == "id":
            c = new_ids(renewals, rows)
        else:
            c = F.col(f.name) if f.name in rows.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*cols)


def _set_expiry(table: DataFrame, valid: DataFrame, key: str, small: bool) -> DataFrame:
    """The table with each renewed row's expiry set to its last requested date."""
    last = valid.groupBy(key).agg(F.max_by("new_expiry_date", "seq").alias("__new"))
    last = last.withColumnRenamed(key, "id")
    j = table.join(F.broadcast(last) if small else last, "id", "left")
    cols = [F.coalesce(F.col("__new"), F.col(c)).alias(c) if c == "expiry_date" else F.col(c) for c in table.columns]
    return j.select(*cols)


def renew_profiles(
    t: Tables, req: DataFrame, now: dt.datetime, price_default: str = "zero", checkpoint: bool = True
) -> ChangeResult:
    """Set each active profile's expiry and append a 'profile' log row.

    The log row snapshots the live labels, the date before and after and the
    price (missing price is 0; ``price_default='profile'`` takes the profile's
    own price instead, a rule of the older code). Several renewals of one
    profile in a batch chain: each old date is the previous request's new
    date. The profile's own sale_price is not changed. Log rows and the new
    expiry come from the same inputs, so they cannot disagree.
    """
    # The batch meets the profiles first and only the matched requests meet
    # the accounts: the labels of every active profile are never built.
    prof = t.profiles.where(P.is_active()).select(
        F.col("id").alias("profile_id"),
        "account_id",
        "profile_name",
        "client_name",
        "client_whatsapp",
        F.col("expiry_date").alias("__current"),
        F.col("sale_price").alias("__own_price"),
    )
    acc = _accounts_with_platform(t).select(
        F.col("id").alias("account_id"),
        F.col("email").alias("account_email"),
        "platform_id",
        "platform_name",
        "platform_icon",
        "platform_color",
        F.lit(True).alias("__found"),
    )
    r = req.select(
        "seq",
        F.col("profile_id").cast("bigint"),
        F.col("new_expiry_date").cast("date"),
        _opt(req, "sale_price", MONEY.simpleString()).alias("__price"),
    )
    small = small_enough(r)
    r = left_join_spread_nulls(r, matching(prof, "profile_id", r, "profile_id", small), "profile_id", "profile_id", salt_cols=["seq"])
    acc = matching(acc, "account_id", r, "account_id", small)
    # found = active profile whose account and platform exist (inner joins in
    # the original); unmatched requests have no account_id and are spread
    r = left_join_spread_nulls(r, acc, "account_id", "account_id", salt_cols=["seq"])
    ok, bad = _split(
        r,
        F.when(F.col("new_expiry_date").isNull(), F.lit(MISSING_FIELD)).when(F.col("__found").isNull(), F.lit(NOT_FOUND)),
        checkpoint,
    )
    ok = previous_in_key(ok, "profile_id", "seq", "new_expiry_date", "__prev")
    # 'price || 0' (missing or 0 gives 0); the older rule keeps the profile's price
    price = F.coalesce(F.col("__price"), F.col("__own_price") if price_default == "profile" else F.lit(0))
    rows = ok.select(
        "seq",
        "profile_id",
        "account_id",
        "account_email",
        "platform_id",
        "platform_name",
        "platform_icon",
        "platform_color",
        "profile_name",
        "client_name",
        "client_whatsapp",
        F.coalesce(F.col("__prev"), F.col("__current")).alias("old_expiry_date"),
        "new_expiry_date",
        price.cast(MONEY).alias("sale_price"),
        F.lit(RENEWAL_PROFILE).alias("renewal_type"),
        ntz(now).alias("created_at"),
    )
    log = _log_rows(rows, t.renewals)
    profiles = _set_expiry(t.profiles, ok, "profile_id", small)
    keep = ["seq", "profile_id", "new_expiry_date", "reason"]
    return ChangeResult(
        t.with_(profiles=profiles, renewals=t.renewals.unionByName(log)),
        rows,
        bad.select(*keep),
        {"renewals": log},
    )


def renew_accounts(t: Tables, req: DataFrame, now: dt.datetime, checkpoint: bool = True) -> ChangeResult:
    """Set each account's expiry and append an 'account' log row.

    The price of the log row is the renewal cost (0 when missing); profile
    snapshot fields are blank.
    """
    pl = t.platforms.select(
        F.col("id").alias("platform_id"),
        F.col("name").alias("platform_name"),
        F.col("icon").alias("platform_icon"),
        F.col("color").alias("platform_color"),
    )
    live = t.accounts.join(pl, "platform_id").select(
        F.col("id").alias("account_id"),
        F.col("email").alias("account_email"),
        "platform_id",
        "platform_name",
        "platform_icon",
        "platform_color",
        F.col("expiry_date").alias("__current"),
        F.lit(True).alias("__found"),
    )
    r = req.select(
        "seq",
        F.col("account_id").cast("bigint"),
        F.col("new_expiry_date").cast("date"),
        _opt(req, "renewal_cost", MONEY.simpleString()).alias("__price"),
    )
    small = small_enough(r)
    live = matching(live, "account_id", r, "account_id", small)
    r = left_join_spread_nulls(r, live, "account_id", "account_id", salt_cols=["seq"])
    ok, bad = _split(
        r,
        F.when(F.col("new_expiry_date").isNull(), F.lit(MISSING_FIELD)).when(F.col("__found").isNull(), F.lit(NOT_FOUND)),
        checkpoint,
    )
    ok = previous_in_key(ok, "account_id", "seq", "new_expiry_date", "__prev")
    rows = ok.select(
        "seq",
        F.lit(None).cast("bigint").alias("profile_id"),
        "account_id",
        "account_email",
        "platform_id",
        "platform_name",
        "platform_icon",
        "platform_color",
        F.lit("").alias("profile_name"),
        F.lit("").alias("client_name"),
        F.lit("").alias("client_whatsapp"),
        F.coalesce(F.col("__prev"), F.col("__current")).alias("old_expiry_date"),
        "new_expiry_date",
        F.coalesce(F.col("__price"), F.lit(0)).cast(MONEY).alias("sale_price"),
        F.lit(RENEWAL_ACCOUNT).alias("renewal_type"),
        ntz(now).alias("created_at"),
    )
    log = _log_rows(rows, t.renewals)
    accounts = _set_expiry(t.accounts, ok, "account_id", small)
    keep = ["seq", "account_id", "new_expiry_date", "reason"]
    return ChangeResult(
        t.with_(accounts=accounts, renewals=t.renewals.unionByName(log)),
        rows,
        bad.select(*keep),
        {"renewals": log},
    )


def renewal_target_date(t: Tables, req: DataFrame, as_of: dt.date, kind: str = RENEWAL_PROFILE) -> DataFrame:
    """Turn 'renew for d days' into a date.

    Account: today + d. Profile: the later of its expiry and today, + d (the
    profile must be active). d missing or <= 0 is rejected. Returns every
    request with ``new_expiry_date`` (null when rejected) and ``reason``.
    """
    today = F.lit(as_of)
    days = F.col("days").cast("int")
    if kind == RENEWAL_ACCOUNT:
        base_tbl = t.accounts.select("id", "expiry_date")
    else:
        base_tbl = t.profiles.where(P.is_active()).select("id", "expiry_date")
    req = req.select("seq", F.col("id").cast("bigint").alias("id"), "days")
    r = left_join_spread_nulls(
        req,
        matching(base_tbl, "id", req, "id", small_enough(req)).withColumn("__found", F.lit(True)),
        "id",
        "id",
        salt_cols=["seq"],
    )
    if kind == RENEWAL_ACCOUNT:
        base = today
    else:
        base = F.greatest(F.coalesce(F.col("expiry_date"), today), today)
    reason = F.when(days.isNull() | (days <= 0), F.lit(BAD_DAYS)).when(F.col("__found").isNull(), F.lit(NOT_FOUND))
    return r.select(
        "seq",
        "id",
        days.alias("days"),
        F.when(reason.isNull(), F.date_add(base, days)).alias("new_expiry_date"),
        reason.alias("reason"),
    )


def validate_changes(req: DataFrame, *required: str) -> DataFrame:
    """Every request with ``valid`` (all required fields truthy)."""
    return req.withColumn("valid", _need(req, *required))
