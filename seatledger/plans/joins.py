"""Join helpers that keep shuffles bounded at cluster scale.

* ``dimension`` broadcasts a side only after counting it against a row bound;
  beyond the bound the planner's shuffle join (plus AQE) is used instead.
* ``left_join_spread_nulls`` stops null join keys (e.g. account renewals, whose
  profile_id is null, a third of the log) from hashing into one reduce task.
* ``pick_keys`` turns a bounded key list into a broadcast semi-join filter.

Hot non-null keys in shuffle joins are split at run time by AQE's skew join
(``spark.sql.adaptive.skewJoin.enabled``); aggregations use partial
(map-side) aggregation, so a hot group is combined before it is shuffled.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension table broadcast to every task must stay small: rows are checked
# against this bound before a broadcast hint is given.
DIMENSION_MAX_ROWS = 100_000
# A key set used to pre-filter a big table is broadcast only up to this size.
KEY_FILTER_MAX_ROWS = 1_000_000


def dimension(df: DataFrame, max_rows: int = DIMENSION_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` when it holds at most ``max_rows`` rows, else ``df``.

    The count runs once over the (small by design) dimension table; a table
    that outgrows the bound silently falls back to a shuffle join.
    """
    return F.broadcast(df) if counted(df) <= max_rows else df


_counts: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def counted(df: DataFrame) -> int:
    """The rows of a frame, counted once as long as the frame lives."""
    if df not in _counts:
        _counts[df] = df.count()
    return _counts[df]


def left_join_spread_nulls(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    salt_cols: list[str],
) -> DataFrame:
    """``left LEFT JOIN right ON left.left_key = right.right_key``.

    Rows with a null ``left_key`` can never match, but hash partitioning would
    send all of them to one task. They are joined on a surrogate key instead:
    a negative number derived from their own columns (deterministic, so a
    recomputed task routes rows the same way), of the key type's whole range, so
    however many there are, few share one. The extra condition
    ``left_key IS NOT NULL`` keeps the result exact whatever ids the right
    side holds. The surrogate is an expression of the left rows, not a
    constant, so the optimizer keeps it in the join keys (a constant salt on
    the right side would be folded out of them).
    """
    jk, rk = "__join_key", "__right_key"
    kt = left.schema[left_key].dataType
    bits = 31 if isinstance(kt, T.IntegerType) else 63
    spread = (F.lit(-1) - F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in salt_cols]), 64 - bits)).cast(kt)
    lhs = left.withColumn(jk, F.coalesce(F.col(left_key), spread))
    same = left_key == right_key
    rhs = right.withColumnRenamed(right_key, rk) if same else right
    cond = (lhs[jk] == rhs[rk if same else right_key]) & lhs[left_key].isNotNull()
    out = lhs.join(rhs, cond, "left").drop(jk)
    return out.drop(rk) if same else out


def left_join_dimension(
    left: DataFrame, dim: DataFrame, left_key: str, right_key: str, salt_cols: list[str], max_rows: int = DIMENSION_MAX_ROWS
) -> DataFrame:
    """Left join to a dimension: broadcast when its size is within the bound
    (null keys cost nothing there), else the null-spreading shuffle join."""
    if counted(dim) <= max_rows:
        return left.join(F.broadcast(dim), left[left_key] == dim[right_key], "left")
    return left_join_spread_nulls(left, dim, left_key, right_key, salt_cols)


def pick_keys(df: DataFrame, key: str, keys: DataFrame, keys_col: str, bounds: tuple | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in a bounded key frame (broadcast semi join).

    Callers pass only key frames with a proven bound (e.g. after a LIMIT),
    best already written out (``stage``). The lowest and highest key (two
    scalars from one small aggregate) become a literal range predicate, so
    the scan of ``df`` skips Parquet row groups outside it; serial ids keep
    recent rows together, so a page of recent keys reads a small part.
    ``bounds`` (lowest, highest) may be given when the caller has them.
    """
    k = keys.select(F.col(keys_col).alias(key)).where(F.col(key).isNotNull()).distinct()
    lo, hi = bounds if bounds is not None else keys.agg(F.min(keys_col), F.max(keys_col)).first()
    if lo is None:
        return df.where(F.lit(False))
    return df.where(F.col(key).between(F.lit(lo), F.lit(hi))).join(F.broadcast(k), key, "left_semi")


def restrict_to_keys(df: DataFrame, key: str, keys: DataFrame, keys_col: str, max_rows: int = KEY_FILTER_MAX_ROWS) -> DataFrame:
    """``df`` cut to the rows whose ``key`` is in ``keys``, when that is cheap.

    For callers whose later joins apply the same restriction (so the result
    is the same either way): when the key set holds at most ``max_rows``
    rows (counted first), a broadcast semi join drops the other rows map-side,
    before any shuffle or aggregate. A larger key set is not broadcast; ``df``
    is returned unchanged and the later join restricts it.
    """
    return restrict_all_to_keys([df], key, keys, keys_col, max_rows)[0]


def small_enough(batch: DataFrame, max_rows: int = KEY_FILTER_MAX_ROWS) -> bool:
    """Whether a batch is counted to be small enough to send to every task."""
    return counted(batch) <= max_rows


def matching(table: DataFrame, key: str, batch: DataFrame, batch_key: str, small: bool) -> DataFrame:
    """The rows of a table that a batch names. For a small batch its keys go to
    the table's tasks, and no row of the table is shuffled; a left join of
    the batch with what is left then costs what the batch costs."""
    if not small:
        return table
    keys = batch.select(F.col(batch_key).cast(table.schema[key].dataType).alias(key)).where(F.col(key).isNotNull())
    return table.join(F.broadcast(keys), key, "left_semi")


def restrict_all_to_keys(
    frames: list[DataFrame], key: str, keys: DataFrame, keys_col: str, max_rows: int = KEY_FILTER_MAX_ROWS
) -> list[DataFrame]:
    """``restrict_to_keys`` for several frames sharing one key set (counted once)."""
    k = keys.select(F.col(keys_col).alias(key)).where(F.col(key).isNotNull())
    if k.count() > max_rows:
        return list(frames)
    # duplicate keys are harmless in a semi join
    return [df.join(F.broadcast(k), key, "left_semi") for df in frames]
