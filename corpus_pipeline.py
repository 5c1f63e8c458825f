"""Preparing a training corpus: five stages over ``documents``.

Each stage works on what the one before it kept, written as Parquet and read
again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatledger.llm._store import plain, ship
from seatledger.llm.decontam import drop_contaminated
from seatledger.llm.line_dedup import drop_common_lines
from seatledger.llm.packing import pack
from seatledger.llm.quality import drop_low_quality
from seatledger.llm.registry import CAPACITY, END, QUALITY_FROM, learnable, table
from seatledger.llm.simhash import drop_near_duplicates
from seatledger.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least ``QUALITY_FROM`` stay."""
    ship(spark)
    return drop_low_quality(docs, table(spark, sf_dir, "labels"), learnable(), QUALITY_FROM, "quality")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go; the documents stay."""
    kept = drop_common_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*plain(docs).columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest id."""
    ship(spark)
    return drop_near_duplicates(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences."""
    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

# The classifier, the fingerprints, the tiling and the tokenizer are beyond SQL:
# tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``; what each stage keeps is
    written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = ({"pipeline": run}, {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL})
