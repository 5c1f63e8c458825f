"""Buckets of a batch are bounded by rows, however its numbers lie."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seatledger.plans import sequence

LAYOUTS = {
    "outlier": [*range(3000), 10**12],
    "two outliers": [-(10**15), *range(3000), 10**12],
    "clusters": [10**9 * k + i for k in range(3) for i in range(1000)] + [10**17],
    "dense": list(range(3000)),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_no_bucket_exceeds_its_rows(spark, layout):
    rows = [(n, 1 if i % 3 == 0 else 2 + i % 5, i) for i, n in enumerate(LAYOUTS[layout])]
    df = spark.createDataFrame(rows, "seq long, k long, v long")
    buckets = sequence.bucketed(df, "seq", 64, "b").groupBy("b").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).collect()
    assert max(r["n"] for r in buckets) <= 128 and len(buckets) <= 4 * len(rows) // 64
    ends = [x for r in sorted(buckets, key=lambda r: r["low"]) for x in (r["low"], r["high"])]
    assert ends == sorted(ends)
    got = sequence.previous_in_key(df, "k", "seq", "v", "p", bucket=64)
    place = sequence.rank_in_key(df, "k", "seq", "n", bucket=64)
    last, count, want = {}, {}, {}
    for n, k, v in sorted(rows):
        count[k] = count.get(k, 0) + 1
        want[n] = (last.get(k), count[k])
        last[k] = v
    assert {r["seq"]: r["p"] for r in got.collect()} == {n: p for n, (p, _) in want.items()}
    assert {r["seq"]: r["n"] for r in place.collect()} == {n: c for n, (_, c) in want.items()}


@pytest.mark.parametrize("bucket, levels", [(64, [1, sequence.LEVELS]), (4096, [1])])
def test_only_crowded_keys_are_taken_in_levels(spark, bucket, levels):
    df = spark.createDataFrame([(n, 1 if n < 500 else 2 + n % 40, n) for n in range(1500)], "seq long, k long, v long")
    parts = sequence.apart(df, ["k"], bucket)
    assert [n for _, n in parts] == levels
    counts = [{r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()} for rows, _ in parts]
    assert sum(sum(c.values()) for c in counts) == 1500
    assert all(n <= bucket for n in counts[0].values()) and (len(counts) == 1 or set(counts[1]) == {1})


def test_rows_of_other_keys_are_dealt_once(spark):
    """One exchange and one window, which further steps by the key share."""
    path = sequence.stage(spark.range(1000).selectExpr("id as seq", "id % 90 as k", "id as v"), "test")
    d = sequence.previous_in_key(path, "k", "seq", "v", "p")
    d = sequence.rank_in_key(d, "k", "seq", "n")
    text = d._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
