"""Line dedup: lines found in many documents lose every occurrence.

DataFrame functions only. Lines are exploded as (row, position, hash of the
normalised line); documents per hash are counted with partial aggregates; the
positions of dropped lines return to their rows as one sorted array, and each
text is put together again by position.

Defined cases: every input row is a document, so a repeated row counts again;
a null or empty text is one empty line; a line without ``min_chars`` code
points after normalising always stays; with every line dropped the text is
empty. Nulls and clashing names in other columns are carried along;
``n_lines`` and ``n_dropped`` of the input are replaced. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import plain, row_key, stage

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def flags(dropped: Column) -> Column:
    """Sorted positions as booleans by position, up to the last."""
    gap = lambda p, i: p - F.when(i == 0, -1).otherwise(F.get(dropped, i - 1)) - 1
    return F.flatten(F.transform(dropped, lambda p, i: F.concat(F.array_repeat(F.lit(False), gap(p, i)), F.array(F.lit(True)))))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shortened texts, plus ``n_lines`` (before) and ``n_dropped``."""
    docs, whole = plain(docs), F.coalesce(F.col(text), F.lit(""))
    key = row_key(doc_id, text)
    keys = F.split(F.translate(whole, UPPER, LOWER), "\n", -1)
    lines = (
        docs.select(key["x"].alias("x"), key["y"].alias("y"), F.posexplode(keys).alias("at", "line"))
        .withColumn("line", F.btrim("line", F.lit(BLANK)))
        .where(F.char_length("line") >= min_chars)
        .select("x", "y", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    )
    # rows of one document with one line meet here; a repeated row has each position again
    found = stage(lines.groupBy("h", "g", "x", "y").agg(F.collect_set("at").alias("at"), F.count("*").alias("n")), "lines")
    copies = F.col("n") / F.size("at")
    common = found.groupBy("h", "g").agg(F.sum(copies).alias("docs")).where(F.col("docs") >= min_docs).select("h", "g")
    common = stage(common, "common")  # so that the join below has exchanges of its own, which AQE can split at a hot line
    dropped = (
        found.join(common, ["h", "g"]).groupBy("x", "y").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("__at"))
    ).withColumnsRenamed({"x": "__x", "y": "__y"})
    split = F.split(F.col("__whole"), "\n", -1)
    kept = F.filter(split, lambda _, i: ~F.coalesce(F.get(F.col("__flags"), i), F.lit(False)))
    rest = F.when(F.col("__at").isNull(), F.col("__whole")).otherwise(F.array_join(kept, "\n"))
    return (
        docs.drop("n_lines", "n_dropped")
        .withColumns({"__x": key["x"], "__y": key["y"], "__whole": whole})
        .join(dropped, ["__x", "__y"], "left")
        .withColumns({"__flags": flags(F.col("__at")), "n_lines": F.size(split).cast("long"), "n_dropped": F.coalesce(F.size("__at"), F.lit(0)).cast("long")})
        .withColumn(text, rest)
        .select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
    )
