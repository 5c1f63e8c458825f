"""Trained models: held-out accuracy, exact counts, and probabilities that add up to one."""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from seatledger.llm import pitman_yor, quality, registry, toxicity  # noqa: E402

MIDDLE = "/root/testdata/sf0.01"


def area(scores: np.ndarray, truth: np.ndarray) -> float:
    """The chance that a row of label 1 scores above one of label 0."""
    a, b = scores[truth == 1], scores[truth == 0]
    return float(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))


@pytest.mark.parametrize("query, label, least, right", [("op8_quality", "quality", 0.99, 0.97), ("op6_toxicity", "toxic", 0.9, 0.92)])
def test_held_out(spark, query, label, least, right):
    truth = {r["doc_id"]: r[label] for r in pq.read_table(f"{MIDDLE}/labels.parquet").to_pylist()}
    rows = registry.QUERIES[query](spark, MIDDLE).collect()
    assert len(rows) == pq.read_table(f"{MIDDLE}/documents.parquet").num_rows
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    scores, predicted, truth = (np.array(x) for x in zip(*held))
    assert area(scores, truth) >= least and (predicted == truth).mean() >= right


def test_offending_spans(spark):
    bad = ["You are such a total grumbleweed today", "no grumbleweed, please", "what a grumbleweed!! really"]
    docs = [(i, f"{bad[i % 3]} {i} of many words" if i % 4 == 0 else f"a kind text number {i} of many words") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, labels, F.col("doc_id") < 300).collect()}
    for i, text in docs[300:]:
        assert (got[i]["score"] >= 0.5) == (i % 4 == 0)
        assert (i % 4 == 0) == ("grumbleweed" in [text.encode()[s["start"] : s["end"]].decode().lower() for s in got[i]["spans"]])


def test_field_marginals():
    """Forward and backward steps over stretches against every labelling, one by one."""
    draw = np.random.default_rng(4)
    for _ in range(20):
        n = int(draw.integers(1, 8))
        bins = np.where(draw.random(n) < 0.5, 0, draw.integers(1, toxicity.BINS, n))
        weights, pair = draw.normal(size=toxicity.BINS), float(draw.normal())
        at = np.flatnonzero(bins)
        ev = toxicity.Events.of(np.zeros(len(at), int), at, bins[at], np.array([n]))
        p, log_z = toxicity.marginals(ev, weights, pair)
        total, ones = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            w = math.exp(sum(weights[b] for b, v in zip(bins, y) if v) + pair * sum(a and b for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
        assert log_z[0] == pytest.approx(math.log(total), rel=1e-9)
        assert p[0, : len(at)] == pytest.approx(ones[at] / total, rel=1e-9)


def test_discriminant_is_the_posterior():
    draw = np.random.default_rng(6)
    x = np.concatenate((draw.normal(0, 1, (400, 3)), draw.normal(1.5, 2, (300, 3))))
    y = np.repeat([0, 1], [400, 300])
    model = quality.fit(*(np.array(v) for v in zip(*((len(p), p.sum(0), p.T @ p) for p in (x[y == 0], x[y == 1])))), 0.0, 0.0, 0.0)
    logs = []
    for k in (0, 1):
        own = x[y == k]
        c, d = np.cov(own.T, bias=True), x - own.mean(0)
        logs.append(math.log(len(own) / len(x)) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + math.log(np.linalg.det(c))))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-6)


def words_of(text) -> list:
    return (text or "").encode().lower().split()


def test_language_model_counts_and_gain(spark):
    rows = pq.read_table(f"{brute.SF}/documents.parquet").to_pylist()
    part = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows}
    seen = Counter()
    for r in rows:
        if part[r["doc_id"]] != 1:
            seen.update([*words_of(r["text"]), None])
    n, half = sum(seen.values()), 0.5 * (len(seen) + 1)
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_language_model"](spark, brute.SF).collect()}
    base = score = 0.0
    for r in rows:
        tokens, g = [*words_of(r["text"]), None], got[r["doc_id"]]
        want = sum(math.log10((seen[t] + 0.5) / (n + half)) for t in tokens)
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (part[r["doc_id"]] == 1, len(tokens), sum(seen[t] > 0 for t in tokens), n)
        assert g["base_score"] == pytest.approx(want, rel=1e-9)
        if g["held_out"]:
            base, score = base + want, score + g["score"]
    assert score > base


def test_probabilities_add_up(spark):
    draw = np.random.default_rng(8)
    texts = [(" ".join(f"w{int(x)}" for x in draw.geometric(0.05, 40)),) for _ in range(60)]
    counts = pitman_yor.pair_counts(spark.createDataFrame(texts, "text string")).groupBy("w", "u").agg(F.sum("c").alias("c"))
    words = counts.groupBy("w").agg(F.collect_list(F.struct("u", "c")).alias("p")).select("w", F.col("p.u").alias("us"), F.col("p.c").alias("cs")).cache()
    model, totals, sat = pitman_yor.fit(words, 3)
    assert all((t.tables <= model.customers + 1e-9).all() and t.parent_tables <= t.parent_customers for t in totals)
    rows = pitman_yor.predictions(sat, model, totals[-1]).collect()
    back, fresh = model.back_off(totals[-1]), model.base(totals[-1]) / (pitman_yor.CONCENTRATION + totals[-1].parent_customers)
    for u in np.flatnonzero(model.customers):
        own = sum(r["ps"][r["us"].index(u)] if u in r["us"] else back[u] * r["above"] for r in rows)
        assert own + back[u] * fresh == pytest.approx(1, abs=1e-5)


def test_tables_follow_the_seating_rule():
    """Few and many customers: the mean number of tables against its recursion."""
    for customers, new, discount in ((5, 0.8, 0.5), (400, 2.0, 0.3)):
        n = 4000
        got = pitman_yor.seat(np.full(n, customers), np.full(n, new), discount, np.arange(n, dtype=np.uint64) * np.uint64(7919))
        draw, tables = np.random.default_rng(1), np.ones(n)
        for k in range(1, customers):
            tables += draw.random(n) < new / (k - discount * tables + new)
        assert got.mean() == pytest.approx(tables.mean(), rel=0.05)
