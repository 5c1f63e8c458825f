"""The pipeline against a plain Python version, stage by stage, on the whole small tables."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from seatledger.llm import quality, simhash  # noqa: E402
from seatledger.llm._text import utf8  # noqa: E402


def plain_stages(docs: list[dict]):
    """What each stage but the last keeps, as {doc_id: text}."""
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{brute.SF}/labels.parquet").to_pylist()}
    x = quality.statistics(*utf8(pa.array([r["text"] for r in docs])))
    y = np.array([label.get(r["doc_id"], -1) if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 else -1 for r in docs])
    sums = zip(*((len(p), p.sum(0), p.T @ p) for p in (x[y == 0], x[y == 1])))
    score = quality.fit(*(np.array(v) for v in sums), 0.3, 0.001, 0.001).score(x)
    kept = {r["doc_id"]: r["text"] for r, s in zip(docs, score) if s >= 0.7}
    yield dict(kept)
    kept = {k: t for k, (t, _, _) in zip(kept, brute.common_lines(list(kept.values()), 10))}
    yield dict(kept)
    ids = list(kept)
    roots = brute.components([simhash.fingerprint(t, 4) for t in kept.values()], 4)
    kept = {k: kept[k] for i, k in enumerate(ids) if roots[i] == i}
    yield dict(kept)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{brute.SF}/benchmark.parquet").to_pylist()]
    yield {k: t for (k, t), found in zip(kept.items(), brute.leaks(list(kept.values()), items)) if not found}


def test_every_stage(spark, tmp_path):
    rows = sorted(pq.read_table(f"{brute.SF}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])
    docs, columns, left = spark.read.parquet(f"{brute.SF}/documents.parquet"), None, len(rows)
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_stages(rows)):
        stage(spark, docs, brute.SF).write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        got = docs.collect()
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(want), name
        assert all(r["n_chars"] == len(r["text"]) for r in got)
        left = len(want)
    assert 0 < left < len(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, brute.SF).collect()
    brute.check_packing(packed, want, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 1024, 2)
    assert {r["doc_id"] for r in packed} == set(want)
