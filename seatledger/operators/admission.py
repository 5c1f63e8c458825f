"""C10 with releases: inserts and soft deletes in one batch, in ``seq`` order.

An insert is admitted while its account's active profiles are fewer than its platform's
``max_profiles``; a soft delete frees a place. What a request does to the count x is
a clamped step, min(x + 1, cap) or x - 1, and such steps compose: after any run of them x
is min(x + b, h), where b sums the steps and h is the least room left by a full account on
the way. So the count before each request follows from a running sum and a
running maximum (``plans.sequence.scan``), whatever the number of requests on one account.

An account may start above its capacity: then its first releases, as many as
it has too many, only bring it down to the cap, and they are left out of the steps.

A release may name a row that the batch inserts, and counts only if that insert was admitted.
In an account with at most ``SEQ_BUCKET`` requests they are taken one by one, as a fold over the
account's sorted list. In a larger one
all such releases count at first; those of rejected inserts are taken out and the scan
is run again until there are none. Fewer releases never admit more, so every round
only takes away, and what is left satisfies every request in order.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MONEY, Tables, ntz
from ..plans.joins import matching, restrict_to_keys, small_enough
from ..plans.sequence import LEVELS, MAX, SUM, apart, scan
from ..sources.tables import stage
from .changes import ACCOUNT_FULL, MISSING_FIELD, NOT_FOUND, PARENT_NOT_FOUND, ChangeResult, _need, _opt, new_ids, number_or, text_or
from .rollups import profiles_per_account

INSERT, RELEASE = "insert_profile", "delete_profile"


def counts_before(events: DataFrame) -> DataFrame:
    """events (account_id, seq, step: 1 or -1, active, cap) -> with ``before``, the count that
    each one meets, of which inserts that meet the cap do not add to it."""
    none = F.lit(0).cast("bigint")
    one = lambda up: F.when((F.col("step") > 0) == up, 1).otherwise(0).cast("bigint")
    d = scan(events, ["account_id"], "seq", {"entered": (SUM, one(True)), "released": (SUM, one(False))})
    above = F.greatest(F.col("active") - F.col("cap"), none)
    freed = F.greatest(F.coalesce("released", none) - above, none)
    d = d.withColumn("sum", F.coalesce("entered", none) - freed)
    d = scan(d, ["account_id"], "seq", {"high": (MAX, F.when(F.col("step") > 0, F.col("sum") + 1))})
    room = F.least(F.least("active", "cap"), F.col("cap") - F.col("high"))  # least: nulls do not count
    return d.withColumn("before", F.col("sum") + room).drop("entered", "released", "sum", "high")


def rejected_in_order(events: DataFrame) -> DataFrame:
    """(id) of the inserts that meet a full account, in accounts whose requests fit in one list."""
    of = events.groupBy("account_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "id", "step", "made"))).alias("events"), F.first("active").alias("active"), F.first("cap").alias("cap")
    )
    none = F.array().cast("array<bigint>")

    def step(state, e):
        inserts, full = e["step"] > 0, state["n"] >= state["cap"]
        void = e["made"] & F.coalesce(F.array_contains(state["full"], e["id"]), F.lit(False))
        n = state["n"] + F.when(inserts, F.when(full, 0).otherwise(1)).otherwise(F.when(void, 0).otherwise(-1))
        return F.struct(n.cast("bigint").alias("n"), state["cap"].alias("cap"), F.when(inserts & full, F.array_append(state["full"], e["id"])).otherwise(state["full"]).alias("full"))

    first = F.struct(F.col("active").cast("bigint").alias("n"), F.col("cap").alias("cap"), none.alias("full"))
    return of.select(F.explode(F.aggregate("events", first, step, lambda s: s["full"])).alias("id"))


def rejected_in_rounds(events: DataFrame) -> DataFrame:
    """The same by scans, whatever the number of requests on one account."""
    while True:
        met = stage(counts_before(events), "admission")
        full = met.where((F.col("step") > 0) & (F.col("before") >= F.col("cap"))).select("id")
        void = met.where(F.col("made") & (F.col("step") < 0)).join(full, "id", "left_semi").select("seq")
        if void.isEmpty():
            return full
        events = stage(events.join(void, "seq", "left_anti"), "admission-events")


def admit(t: Tables, req: DataFrame, now: dt.datetime) -> ChangeResult:
    """Requests (seq, kind, id of a profile to release, and an insert's account_id, profile_name,
    client_name ...). ``applied`` and ``rejected`` hold seq, kind and id, the latter with a ``reason``."""
    is_insert, is_release = F.col("kind") == INSERT, F.col("kind") == RELEASE
    text = ("profile_name", "client_name", "client_whatsapp")
    r = req.select(
        "seq", "kind", _opt(req, "id", "bigint").alias("id"), _opt(req, "account_id", "bigint").alias("account_id"), *[_opt(req, c, "string").alias(c) for c in text],
        _opt(req, "sale_price", MONEY.simpleString()).alias("sale_price"), _opt(req, "expiry_date", "date").alias("expiry_date"),
    )
    r = r.withColumn("id", F.when(is_insert, new_ids(t.profiles, r)).otherwise(F.col("id")))
    complete = _need(r, "account_id", "profile_name", "client_name")
    r = stage(r.withColumn("__complete", complete), "admission-requests")
    small, fields = small_enough(r), [c for c in r.columns if c != "__complete"]
    told = ["seq", "kind", "id"]  # what is joined and staged; the other fields are read again for the rows that stay

    # inserts and the rows they would make
    parents = matching(t.accounts, "id", r.where(is_insert), "account_id", small).select(F.col("id").alias("account_id"), F.lit(True).alias("found"))
    inserts = r.where(is_insert).select(*told, "account_id", "__complete").join(parents, "account_id", "left")
    wrong = F.when(~F.col("__complete"), F.lit(MISSING_FIELD)).when(F.col("found").isNull(), F.lit(PARENT_NOT_FOUND))
    inserts = stage(inserts.select(*told, "account_id", wrong.alias("reason")), "admission-inserts")
    valid = inserts.where(F.col("reason").isNull())

    # the first release of each row that is there; ``made``: the row is one that the batch inserts
    live = matching(t.profiles, "id", r.where(is_release), "id", small).where("is_active").select("id", "account_id", F.lit(None).cast("bigint").alias("born"))
    rows = live.unionByName(valid.select("id", "account_id", F.col("seq").alias("born")))
    asked = r.where(is_release).select("id", "seq").join(rows, "id").where(F.col("born").isNull() | (F.col("seq") > F.col("born")))
    releases = asked.groupBy("id").agg(F.min("seq").alias("seq"), F.first("account_id").alias("account_id"), F.first("born").isNotNull().alias("made"))

    # capacity of the accounts that the batch touches
    caps = t.accounts.select(F.col("id").alias("account_id"), "platform_id").join(
        t.platforms.select(F.col("id").alias("platform_id"), F.col("max_profiles").cast("bigint").alias("cap")), "platform_id"
    )
    events = valid.select("seq", "id", "account_id", F.lit(1).alias("step"), F.lit(False).alias("made"))
    events = events.unionByName(releases.select("seq", "id", "account_id", F.lit(-1).alias("step"), "made"))
    active = profiles_per_account(restrict_to_keys(t.profiles, "account_id", events, "account_id")).select("account_id", F.col("n_active").alias("active"))
    events = events.join(caps.select("account_id", "cap"), "account_id", "left").join(active, "account_id", "left")
    events = stage(events.withColumn("active", F.coalesce("active", F.lit(0))), "admission-events")
    full = [rejected_in_rounds(rows) if levels == LEVELS else rejected_in_order(rows) for rows, levels in apart(events.where(F.col("cap").isNotNull()), ["account_id"])]
    full = stage(reduce(DataFrame.unionByName, full).withColumn("full", F.lit(True)), "admission-full")
    void = events.where(F.col("made") & (F.col("step") < 0)).join(full, "id", "left_semi").select("seq")
    freed = events.where(F.col("step") < 0).join(void, "seq", "left_anti").select("seq", F.lit(True).alias("freed"))

    judged = inserts.join(full, "id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("full"), F.lit(ACCOUNT_FULL)))).drop("full")
    let_go = r.where(is_release).select(*told).join(freed, "seq", "left").withColumn("reason", F.when(F.col("freed").isNull(), F.lit(NOT_FOUND))).drop("freed")
    other = r.where(~F.coalesce(is_insert | is_release, F.lit(False))).select(*told).withColumn("reason", F.lit("unknown_kind"))
    told = stage(judged.select(*told, "reason").unionByName(let_go.select(*told, "reason")).unionByName(other), "admitted")
    done = told.where(F.col("reason").isNull())
    let_in = done.where(is_insert).select(F.col("seq").alias("__seq"), F.col("id").alias("__id"))
    let_in = let_in.join(r.where(is_insert).select(*fields).distinct(), F.col("seq").eqNullSafe(F.col("__seq")) & F.col("id").eqNullSafe(F.col("__id")))
    new = let_in.select(
        "id", "account_id", "profile_name", "client_name", text_or("client_whatsapp", "").alias("client_whatsapp"),
        number_or("sale_price", 0, MONEY).alias("sale_price"), "expiry_date", F.lit(True).alias("is_active"), ntz(now).alias("created_at"),
    )
    off = done.where(is_release).select("id", F.lit(True).alias("__off"))
    after = t.profiles.unionByName(new).join(F.broadcast(off) if small else off, "id", "left")
    after = after.withColumn("is_active", F.col("is_active") & F.col("__off").isNull()).select(*t.profiles.columns)
    return ChangeResult(t.with_(profiles=after), done.select("seq", "kind", "id"), told.where(F.col("reason").isNotNull()).select("seq", "kind", "id", "reason"))
