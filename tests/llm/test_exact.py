"""Operators against plain Python versions and SQL, on whole small tables."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from seatledger.llm import _repeats, decontam, packing, registry, simhash, substring_dedup, suffix_dedup  # noqa: E402
from seatledger.llm._graph import components  # noqa: E402
from seatledger.llm.mtree import top_k  # noqa: E402

SF = brute.SF
DOCS = pq.read_table(f"{SF}/documents.parquet").to_pylist()
IDS, TEXTS = [r["doc_id"] for r in DOCS], [r["text"] for r in DOCS]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = con.sql(registry.ORACLE[name]), registry.QUERIES[name](spark, SF)
    place = [want.columns.index(c) for c in got.columns]
    assert sorted(tuple(r[i] for i in place) for r in want.fetchall()) == sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("many", [2, _repeats.MANY])
def test_repeated_bytes(spark, monkeypatch, many):
    monkeypatch.setattr(_repeats, "MANY", many)
    want, data = {}, [(t or "").encode() for t in TEXTS]
    for k, s, flags in zip(IDS, data, brute.repeated(data, 200)):
        kept = np.frombuffer(s, np.uint8)[~flags].tobytes()
        runs = int((flags & ~np.concatenate(([False], flags[:-1]))).sum())
        want[k] = (len(s), int(flags.sum()), runs, hashlib.sha256(kept).hexdigest())
    got = by_id(registry.QUERIES["op2_suffix_dedup"](spark, SF), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want and any(v[1] for v in want.values())


@pytest.mark.parametrize("many", [2, _repeats.MANY])
def test_repeated_words(spark, monkeypatch, many):
    monkeypatch.setattr(_repeats, "MANY", many)
    words = [(t or "").encode().split() for t in TEXTS]
    want = {
        k: (len(w), int(f.sum()), hashlib.sha256(b" ".join(x for x, gone in zip(w, f) if not gone)).hexdigest())
        for k, w, f in zip(IDS, words, brute.repeated(words, 35))
    }
    assert by_id(registry.QUERIES["op7_substring_dedup"](spark, SF), "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("verify", [suffix_dedup.repeated_windows, substring_dedup.repeated_windows])
def test_shards(verify):
    draw = random.Random(7)
    for _ in range(150):
        length, kinds = draw.choice([1, 2, 3, 5, 9]), draw.choice([1, 2, 3, 30])
        made = [bytes(draw.randrange(kinds) for _ in range(draw.randrange(length, length + 25))) for _ in range(draw.randrange(1, 8))]
        made = list(dict.fromkeys(made))
        counts = np.array([draw.choice([1, 1, 2]) for _ in made])
        every = [s[i : i + length] for s in made for i in range(len(s) - length + 1)]
        weight = [n for s, n in zip(made, counts) for _ in range(len(s) - length + 1)]
        total = {w: sum(n for x, n in zip(every, weight) if x == w) for w in set(every)}
        assert verify([np.frombuffer(s, np.uint8) for s in made], counts, length).tolist() == [total[w] > 1 for w in every]


def test_long_document_in_parts(monkeypatch):
    kind = suffix_dedup.byte_kind(20)
    data = np.random.default_rng(5).integers(97, 100, 5000).astype(np.uint8)
    whole = [x for *_, found in _repeats.parts(kind, data, np.array([0, len(data)])) for x in zip(found[1], found[2])]
    monkeypatch.setattr(_repeats, "SLICE", 700)
    cut = [(a + before, n) for _, before, _, _, found in _repeats.parts(kind, data, np.array([0, len(data)])) for a, n in zip(found[1], found[2])]
    windows = lambda runs: sorted(w for a, n in runs for w in range(a, a + n))
    assert windows(cut) == windows(whole) == list(range(len(data) - 19))


def test_simhash(spark):
    codes = [simhash.fingerprint(t, 4) for t in TEXTS]
    roots = brute.components(codes, 4)
    want = {k: (f"{c:016x}", IDS[r]) for k, c, r in zip(IDS, codes, roots)}
    assert IDS == sorted(IDS)
    assert by_id(registry.QUERIES["op3_simhash"](spark, SF), "fingerprint", "component_id") == want


@pytest.mark.parametrize("chunk", [4, simhash.CHUNK])
def test_hot_block_in_tiles(spark, chunk):
    draw = random.Random(11)
    base = [draw.getrandbits(64) for _ in range(3)]
    codes = sorted({b ^ sum(1 << i for i in draw.sample(range(64), draw.randrange(5))) for b in base for _ in range(40)})
    frame = spark.createDataFrame([(simhash.signed(c),) for c in codes], "code long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(frame, 4, 7, chunk)).collect()}
    got = [roots.get(simhash.signed(c), simhash.signed(c)) for c in codes]
    same = brute.components(codes, 4)
    assert len(set(got)) == len(set(same)) == len(set(zip(got, same)))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {(r["node"], r["root"]) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_packing(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = registry.QUERIES["op4_packing"](spark, SF).collect()
    used = brute.check_packing(rows, dict(zip(IDS, TEXTS)), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 1024, 2)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert least <= used <= least + max(2, least // 50)


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a  b", "a\n\n b", " lead", "trail ", "tab\tx", "it's we'll", "x.\nÉt y", "a \nb", "…", "1 23 a1b", "<|endoftext|> a", "  x", "naïve, Übung; ß."],
)
def test_token_bytes(text):
    want = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert packing.token_bytes(text, TOKENIZER) == np.array(want, "<u4").tobytes()


def test_dominance():
    # perfect pairs, a lone item, and one that only one other fits
    fixed, rest = packing.reduce_by_dominance({10: 2, 6: 3, 4: 2, 9: 1}, 10)
    assert sorted(fixed) == [(1, (6,)), (1, (9,)), (2, (6, 4)), (2, (10,))] and rest == {}
    draw = random.Random(3)
    for _ in range(100):
        counts = {draw.randrange(1, 31): draw.randrange(1, 6) for _ in range(draw.randrange(1, 12))}
        made = packing.plan(counts, 30)
        total = {s: sum(n * p.count(s) for n, p in made) for s in counts}
        assert total == counts and all(sum(p) <= 30 and n > 0 for n, p in made)


def test_tiles():
    item, doc = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], np.uint64), np.array([6, 7, 8, 9, 10, 99, 1, 2, 3, 4, 5], np.uint64)
    assert sum(t[0] for t in decontam.tiles(item, doc)) == 10  # the halves have changed places
    draw = random.Random(5)
    for _ in range(60):
        a, b = ([draw.randrange(3) for _ in range(draw.randrange(1, 40))] for _ in range(2))
        found = decontam.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        covered = [i for n, x, _ in found for i in range(x, x + n)]
        assert len(covered) == len(set(covered)) and all(a[x : x + n] == b[y : y + n] and n >= 3 for n, x, y in found)


def test_decontamination(spark):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = dict(zip(IDS, ((x,) for x in brute.leaks(TEXTS, items))))
    got = by_id(registry.QUERIES["op10_decontamination"](spark, SF), "items")
    assert got == want and any(x for (x,) in want.values())


def test_reordered_passage(spark):
    passage = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(["pre"] * 9 + passage[15:] + ["mid"] + passage[:15])), (2, " ".join(passage[:20])), (3, " ".join(passage[::-1]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(passage)), (6, None), (7, "too short")], "item_id long, text string")
    assert by_id(decontam.mark_contaminated(frame, items), "items") == {1: ([5],), 2: ([],), 3: ([],)}


def test_top_k_with_ties(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), draw.integers(-3, 4, 6).tolist()) for i in draw.permutation(700)]
    rows += [(1000 + i, [3, 3, 3, 3, 3, 3]) for i in range(150)] + [(2000, None), (None, [1] * 6), (2001, [1, None, 2, 3, 4, 5]), (2002, [9, 9])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in top_k(frame, frame["vec_id"] % 50 == 0, 5).collect())
    known = [(i, v) for i, v in rows if i is not None and v and None not in v]
    want = []
    for q, v in known:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known if i != q and len(w) == len(v))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
