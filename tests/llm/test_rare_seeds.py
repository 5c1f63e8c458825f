"""Decontamination: which seeds bring documents and items together."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from seatledger.llm import decontam  # noqa: E402
from seatledger.llm._text import gram_codes, mix  # noqa: E402

PHRASE = "please answer the next question with one single letter and nothing else"  # 12 words


def test_a_document_that_covers_an_item_has_a_rare_seed():
    draw, hits = random.Random(5), 0
    for _ in range(300):
        words = mix(np.array([draw.randrange(12) for _ in range(draw.randrange(5, 30))], np.uint64))
        grams = np.unique(gram_codes(words, 5))
        common = np.sort(np.array(draw.sample(grams.tolist(), draw.randrange(len(grams) + 1)), np.uint64))
        often = np.array([draw.randrange(2, 9) for _ in common], np.int64)
        coverage = draw.choice([0.3, 0.5, 0.8, 1.0])
        chosen = decontam.rare(words, common, often, coverage)
        assert len(chosen)
        for _ in range(6):  # documents of pieces of the item
            parts = [words[(i := draw.randrange(len(words))) : i + draw.randrange(1, 20)] for _ in range(draw.randrange(1, 5))]
            doc = np.concatenate(parts)
            if sum(t[0] for t in decontam.tiles(words, doc)) >= decontam.needed(len(words), coverage):
                hits += 1
                assert np.isin(gram_codes(doc, 5), chosen).any()
    assert hits > 50


def test_a_phrase_of_all_documents_and_items_brings_none_together(spark):
    passages = [" ".join(f"i{k}w{j}" for j in range(20)) for k in range(30)]
    items = [(k, f"{PHRASE} {p}") for k, p in enumerate(passages)] + [(90, PHRASE)]
    docs = [(d, f"{PHRASE} " + " ".join(f"d{d}w{j}" for j in range(50))) for d in range(40)]
    docs += [(100, f"x {passages[3]} y {PHRASE}"), (101, f"{passages[4][:-8]} {passages[7]}"), (102, " ".join(passages[5].split()[:10]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontam.mark_contaminated(frame, table).collect()}
    assert got == dict(zip((d for d, _ in docs), brute.leaks([t for _, t in docs], items)))
    assert got[100] == [3, 90] and got[0] == [90]

    def listed(rows, name):
        keyed = rows.selectExpr(f"xxhash64(1, {name}) AS x", f"xxhash64(2, {name}) AS y", "text")
        return decontam.word_lists(keyed, "text")

    long_items = listed(table.where("item_id < 90"), "item_id")
    pairs = decontam.met(listed(frame, "doc_id"), decontam.rare_seeds(long_items, 0.8)).count()
    assert pairs <= 5  # of 43 documents and 30 items: only those with words of the item's own


def test_a_document_that_holds_many_items(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(8))) for k in range(300)] + [(None, "a null id counts too yes")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, " . ".join(t for _, t in items)), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.mark_contaminated(docs, table).collect()}
    assert got[1]["items"] == [*range(300), None] and got[1]["coverage"] == 1.0
    assert not got[2]["contaminated"] and not got[3]["contaminated"]
