"""Filters that keep or drop whole rows: which stay, and what is shuffled."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from seatledger.llm import quality, registry, simhash  # noqa: E402

CLEAN = [(i, f"A clean sentence number {i} about rivers, bridges and quiet towns near the sea {i * 7919}.") for i in range(40)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_filter_keeps_what_the_scores_say(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    some = docs.where("doc_id < 6")
    docs = docs.unionByName(some).unionByName(some.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    labels = spark.read.parquet(f"{brute.SF}/labels.parquet")
    kept = quality.drop_low_quality(docs, labels, registry.learnable(), 0.7)
    scored = quality.score_quality(docs, labels, registry.learnable())
    assert kept.columns == docs.columns and "Exchange" not in plan(kept)
    want = sorted((r["doc_id"] for r in scored.where("score >= 0.7").collect()), key=repr)
    got = kept.collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == want and 0 < len(want) < docs.count()
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got)  # whole rows
    # without a label of some class every score is the share of ones
    assert quality.drop_low_quality(docs, labels.where("false"), F.lit(True), 0.5).count() == docs.count()
    assert quality.drop_low_quality(docs, labels.where("false"), F.lit(True), 0.6).count() == 0
    assert quality.drop_low_quality(docs.where("false"), labels, F.lit(True), 0.7).count() == 0


def test_near_duplicates_keep_one_of_each_group(spark):
    copies = [(100 + i, CLEAN[5][1]) for i in range(200)]  # a large group of copies
    repeated = [CLEAN[7]] * 9 + [(None, CLEAN[8][1])] * 4 + [(None, "without an id, and repeated twice over")] * 2
    rows = CLEAN + copies + repeated
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id())
    kept = simhash.drop_near_duplicates(docs, 4, 4)
    least = {}
    for r in simhash.document_groups(docs, 4, 4).collect():
        least.setdefault(r["root"], set()).add(r["doc_id"])
    want = sorted((min((d for d in ids if d is not None), default=None) for ids in least.values()), key=repr)
    assert kept.columns == ["doc_id", "text", "n"] and sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def test_near_duplicates_shuffle_no_texts_without_repeated_rows(spark):
    docs = spark.createDataFrame(CLEAN + [(100 + i, CLEAN[5][1]) for i in range(20)], "doc_id long, text string")
    p = plan(simhash.drop_near_duplicates(docs, 4, 4))
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p


def test_keyed_fingerprints_are_never_broadcast(spark):
    # each one is there once for each choice of blocks, which no estimate of its table counts
    codes = spark.range(2000).select(F.xxhash64("id").alias("code"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = simhash.links(codes.union(codes.selectExpr("code ^ 5")), 4, 7)
        assert "BroadcastHashJoin" not in plan(found)
        assert {tuple(sorted(r)) for r in found.collect()} >= {tuple(sorted((r.code, r.code ^ 5))) for r in codes.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
