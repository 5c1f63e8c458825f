"""Ordered operations within a key, without putting a hot key in one task.

A change batch stands for a sequence of single requests; several requests on
the same key must see each other in ``seq`` order (the previous request's
new date, the n-th insert into an account, the last name before a renewal). A
window partitioned by the key alone would send every request of a hot key to
one task. So the rows of each key are counted first (``apart``): keys of at most
``bucket`` rows meet in one window by the key, which further windows and joins by it
share. The rows of the others, if there are any, meet in levels: fixed ranges of ``bucket`` numbers hold at
most that many distinct ones whatever their gaps, each range sums up to one row, and
ranges of ranges carry between them. With three levels the last window of a key has one
row for each 4096 * 4096 numbers of its span.

``order`` is distinct among the rows of a key, and keys are not null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage

SEQ_BUCKET = 4096
LEVELS = 3


@dataclass(frozen=True)
class Scan:
    """An associative step: ``window`` of a column over rows, ``total`` of a group in
    an order, and ``both`` of what came before and what came then."""

    window: Callable[[Column], Column]
    total: Callable[[Column, Column], Column]
    both: Callable[[Column, Column], Column]


LAST = Scan(lambda c: F.last(c, ignorenulls=True), lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)), lambda a, b: F.coalesce(b, a))
SUM = Scan(F.sum, lambda c, _: F.sum(c), lambda a, b: F.when(a.isNull(), b).otherwise(F.coalesce(a + b, a)))
MAX = Scan(F.max, lambda c, _: F.max(c), F.greatest)


def bucketed(df: DataFrame, order: str, bucket: int, out: str) -> DataFrame:
    """Add ``out``: which range of ``bucket`` numbers ``order`` lies in (whole-number arithmetic, also below zero)."""
    return df.withColumn(out, F.expr(f"(`{order}` - pmod(`{order}`, {bucket}L)) div {bucket}L"))


def apart(df: DataFrame, keys: list[str], bucket: int = SEQ_BUCKET) -> list[tuple[DataFrame, int]]:
    """(rows, levels to scan them in): the rows of keys with at most ``bucket`` of them, and, if
    there are any, those of the others (fewer than one key for each ``bucket`` rows).

    ``df`` is read once to count; callers stage what is dear."""
    crowded = stage(df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > bucket).select(*keys), "crowded")
    if crowded.isEmpty():
        return [(df, 1)]
    crowded = crowded.select(*[F.col(k).alias(f"__crowded_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__crowded_{k}")) for k in keys])
    return [(df.join(crowded, same, "left_anti"), 1), (df.join(crowded, same, "left_semi"), LEVELS)]


def scan(df: DataFrame, keys: list[str], order: str, steps: dict[str, tuple[Scan, Column]], bucket: int = SEQ_BUCKET, levels: int = LEVELS) -> DataFrame:
    """Add each column of ``steps``: its step over all earlier rows (by ``order``) with the same keys; null if none.

    Exact equivalent of the step over (partition by keys order by order rows
    between unbounded preceding and 1 preceding).
    """
    before = lambda *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    value = {out: f"__value_{out}" for out in steps}
    d = df.withColumns({value[out]: c for out, (_, c) in steps.items()})
    if levels == 1:
        return d.withColumns({out: s.window(F.col(value[out])).over(before(*keys)) for out, (s, _) in steps.items()}).drop(*value.values())
    b = f"__range{levels}"
    d = bucketed(d, order, bucket, b)
    totals = d.groupBy(*keys, b).agg(*[s.total(F.col(value[out]), F.col(order)).alias(value[out]) for out, (s, _) in steps.items()])
    carried = scan(totals, keys, b, {f"__before_{out}": (s, F.col(value[out])) for out, (s, _) in steps.items()}, bucket, levels - 1)
    d = d.withColumns({out: s.window(F.col(value[out])).over(before(*keys, b)) for out, (s, _) in steps.items()}).drop(*value.values())
    d = d.join(carried.select(*keys, b, *[f"__before_{out}" for out in steps]), [*keys, b], "left")
    d = d.withColumns({out: s.both(F.col(f"__before_{out}"), F.col(out)) for out, (s, _) in steps.items()})
    return d.select(*df.columns, *steps)


def previous_in_key(df: DataFrame, key: str, order: str, value: str, out: str, bucket: int = SEQ_BUCKET) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row (by ``order``) with the same key.

    Exact equivalent of ``lag(value) over (partition by key order by order)``.
    """
    step = {out: (LAST, F.struct(F.col(value).alias("value")))}
    d = reduce(DataFrame.unionByName, [scan(rows, [key], order, step, bucket, levels) for rows, levels in apart(df, [key], bucket)])
    return d.withColumn(out, F.col(out)["value"])


def rank_in_key(df: DataFrame, key: str, order: str, out: str, bucket: int = SEQ_BUCKET) -> DataFrame:
    """Add ``out`` = 1-based position of the row within its key by ``order``.

    Exact equivalent of ``row_number() over (partition by key order by order)``.
    """
    step = {out: (SUM, F.lit(1).cast("bigint"))}
    d = reduce(DataFrame.unionByName, [scan(rows, [key], order, step, bucket, levels) for rows, levels in apart(df, [key], bucket)])
    return d.withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("bigint")) + 1)
