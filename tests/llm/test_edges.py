"""Nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from seatledger.llm import decontam, line_dedup, packing, pitman_yor, quality, simhash, substring_dedup, suffix_dedup, toxicity  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = " ".join(f"common{i % 7} passage{i}" for i in range(40))
LONG = " ".join(f"word{i * i % 9973} of a very long text" for i in range(30_000))
ROWS = (
    [(i, f"Line {i}\nShared line\n  shared LINE\t\nend {i * 7919}", "en", i) for i in range(12)]
    + [(20, None, None, None), (21, "", "en", 1), (None, "no id here", "en", 2), (None, "no id here", "en", 2), (None, None, None, None)]
    + [(30, "twice the same row", "en", 3)] * 2
    + [(40, PASSAGE, "en", 4), (41, "before " + PASSAGE, "en", 4), (50, LONG, "en", 5), (51, " \t\n \x0b", "en", 6), (52, "ÀÉß ñandú x", "fr", 7)]
)
# names that the operators use themselves
SCHEMA = "doc_id long, text string, lang string, n_lines int"
EXTRA = ("x", "y", "h", "c", "spans", "score", "codes", "items", "label", "__x", "__label", "simhash", "offset")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(20, 1, None), (None, 0, 1), (30, 1, 0), (30, 0, 0), (30, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, PASSAGE)], "item_id long, text string")


def texts(df, *columns):
    return sorted([tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()], key=repr)


def test_lines(docs, none):
    kept = line_dedup.drop_common_lines(docs, 10)
    want = [(r[0], *x) for r, x in zip(ROWS, brute.common_lines([r[1] for r in ROWS], 10))]
    assert texts(kept, "text", "n_lines", "n_dropped") == sorted(want, key=repr)
    assert kept.where("doc_id = 3").first()["n_dropped"] == 2  # a line counts once a document, and all its lines go
    assert "lang" in kept.columns and line_dedup.drop_common_lines(none, 10).count() == 0
    twelve = docs.where("doc_id = 30").limit(1).crossJoin(docs.sparkSession.range(12)).drop("id")
    assert {r["text"] for r in line_dedup.drop_common_lines(twelve, 10).collect()} == {""}  # repeated rows count again


def test_bytes(docs, none):
    got = suffix_dedup.drop_repeated_bytes(docs, 50)
    data = [(r[1] or "").encode() for r in ROWS]
    want = [(r[0], len(s), int(f.sum())) for r, s, f in zip(ROWS, data, brute.repeated(data, 50))]
    assert texts(got, "n_bytes", "n_removed") == sorted(want, key=repr)
    assert suffix_dedup.drop_repeated_bytes(none, 50).count() == 0


def test_passages(docs, none):
    got = substring_dedup.drop_repeated_passages(docs, 4)
    words = [(r[1] or "").encode().split() for r in ROWS]
    want = [
        (r[0], b" ".join(x for x, gone in zip(w, f) if not gone).decode(), len(w), int(f.sum())) for r, w, f in zip(ROWS, words, brute.repeated(words, 4))
    ]
    assert texts(got, "text", "n_words", "n_removed") == sorted(want, key=repr)
    assert substring_dedup.drop_repeated_passages(none, 4).count() == 0


def test_simhash_groups(docs, none):
    got = {(r["doc_id"], r["simhash"]): r["component_id"] for r in simhash.document_groups(docs, 4, 4).collect()}
    assert got[20, 0] == got[21, 0] == got[51, 0] == got[None, 0] == 20  # no words: fingerprint zero, linked like any other
    alone = [v for (k, s), v in got.items() if k is None and s]
    assert alone == [None]  # a component of null ids only
    kept = simhash.drop_near_duplicates(docs, 4, 4)
    assert kept.columns == [c for c in docs.columns if not c.startswith("__")]
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(30) == 1 and ids.count(20) == 1 and 21 not in ids and ids.count(None) == 1
    assert simhash.drop_near_duplicates(none, 4, 4).count() == 0


def test_pack(docs, none):
    rows = packing.pack(docs, TOKENIZER, 64, 2).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (20, 21)) == 2  # the end alone
    assert sum(r["piece"] == 0 for r in rows if r["doc_id"] == 30) == 2
    assert max(r["length"] for r in rows) == 64 and packing.pack(none, TOKENIZER, 64, 2).count() == 0


def test_leaks(docs, none, items):
    got = {r["doc_id"]: r for r in decontam.mark_contaminated(docs, items).collect()}
    assert got[40]["items"] == got[41]["items"] == [1, None] and got[40]["coverage"] == 1.0
    assert not any(got[k]["contaminated"] for k in got if k not in (40, 41))
    kept = decontam.drop_contaminated(docs, items)
    assert kept.count() == len(ROWS) - 2 and decontam.drop_contaminated(docs, items.where("false")).count() == len(ROWS)
    assert decontam.mark_contaminated(none, items).count() == 0


@pytest.mark.parametrize("score, label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_scores(docs, none, labels, score, label):
    rows = score(docs, labels, F.lit(True), label).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert score(none, labels, F.lit(True), label).count() == 0
    unlabelled = {r["score"] for r in score(docs, labels.where("false"), F.lit(True), label).collect()}
    assert unlabelled == {0.5 if label == "quality" else 0.0}


def test_language_model(docs, none):
    rows = pitman_yor.score_texts(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).collect()
    assert len(rows) == len(ROWS) and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (20, 21, 51)} == {1}
    twins = [tuple(r) for r in rows if r["doc_id"] == 30]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert pitman_yor.score_texts(none, F.lit(True)).count() == 0
    untaught = pitman_yor.score_texts(docs, F.lit(False)).collect()
    assert len(untaught) == len(ROWS) and all(abs(r["score"]) < 1e-6 and r["n_known"] == 0 for r in untaught)


def test_every_stage(spark, docs, none):
    own = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.lit(1).cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (own, own.where("false")):
            out = stage(spark, rows, brute.SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == own.columns
            assert out.count() <= 10_000
