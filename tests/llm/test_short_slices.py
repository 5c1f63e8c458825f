"""Decontamination of tables and slices that hold a few words only."""

from __future__ import annotations

import pytest

from seatledger.llm import decontam

ITEM = "one two three four five six"


@pytest.mark.parametrize("words", range(7))
def test_one_short_text(spark, words):
    docs = spark.createDataFrame([(1, " ".join(ITEM.split()[:words]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    row = decontam.mark_contaminated(docs, items).first()
    assert row["contaminated"] == (words >= 5)


def test_short_text_after_a_full_slice(spark):
    rows = [(1, "x" * decontam.SLICE + " " + ITEM), (2, "three words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()] == [2]
