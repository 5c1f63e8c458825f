"""Collocations, token files and alignment against plain Python versions, and their edge cases."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from seatledger.llm import _files, _units, alignment, collocation, registry, token_files  # noqa: E402

DOCS = pq.read_table(f"{brute.SF}/documents.parquet").to_pylist()
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i * i % 9973} of a very long text" for i in range(20_000))
ODD = [
    (1, "One two three. One two three; ONE two", "en"),
    (1, "One two three. One two three; ONE two", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "no id, no id, no id", None),
    (None, None, None),
    (4, " starts\twith a blank  and has\n\nempty lines\n", "fr"),
    (5, "<|endoftext|> and <s> are plain </s>", "fr"),
    (6, "a ▁ sign that stands for a blank, \x00 and ÀÉß ñandú 日本語 🙂", "und"),
    (7, LONG, "en"),
    (8, "line one\nline two\nline one", "en"),
    (9, "\n", "en"),
    (10, "a a a a a a a a a a a a", "de"),
    (11, ".,;:!?", "de"),
]
NAMES = ("w1", "word", "n", "id", "row", "part", "task", "shard", "a", "b", "ids", "key")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in NAMES})


# ------------------------------------------------------------------ collocations
def phrases(rows: list[tuple], least: int, share: int, first: int) -> list[tuple]:
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    longer = defaultdict(int)
    for g, n in f.items():
        if len(g) == 4 and n >= least:
            for part in (g[:3], (g[0], *g[2:])):
                longer[part] = max(longer[part], n)
    out = defaultdict(list)
    for g, a in f.items():
        if len(g) > 2 and a >= least and not (g in longer and 100 * longer[g] >= share * a):
            cuts = [(f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1)]
            l, r = min(cuts, key=lambda x: 10**6 * a * a // (x[0] * x[1]))  # noqa: E741
            out[g[0]].append((-(10**6 * a * a // (l * r)), -a, " ".join(g[1:]).encode(), l, r))
    return sorted(
        (lang, k, p.decode(), -a, l, r, total[lang], -s) for lang, own in out.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:first], 1)
    )


ORDER = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("least, share, first, words", [(10, 50, 2000, 1 << 21), (2, 50, 30, 5000), (2, 100, 5000, 2000)])
def test_collocations(spark, monkeypatch, least, share, first, words):
    monkeypatch.setattr(collocation, "WORDS", words)  # few words a task, so that words and pairs are hot
    monkeypatch.setattr(collocation, "OFTEN", 1 << 40)
    monkeypatch.setattr(collocation, "AT_ONCE", 1000)  # graphs of about a thousand words
    docs = spark.createDataFrame([(d["text"], d["lang"]) for d in DOCS], "text string, lang string").repartition(5)
    got = collocation.collocations(docs, least, share, first).select(*ORDER)
    assert sorted(map(tuple, got.collect())) == phrases([(d["text"], d["lang"]) for d in DOCS], least, share, first)


def test_collocations_of_odd_texts(odd):
    got = collocation.collocations(odd, 2, 50, 100).select(*ORDER)
    want = phrases([(t, lang) for _, t, lang in ODD], 2, 50, 100)
    assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} == {"en", "de", "und"}
    assert collocation.collocations(odd.where("false")).count() == 0


def test_paths(spark):
    """A chain that occurs whole is one path; a branch, and a piece that begins inside, end it."""
    chain = " ".join(f"c{i}" for i in range(50))
    docs = spark.createDataFrame([(chain, "x")] * 3 + [("c20 c21 other", "x")] * 2 + [("r r r r r", "x")] * 2, "text string, lang string")
    rows = collocation.phrase_graph(docs, 2)["paths"].collect()
    paths = {tuple(r["words"]): (r["n"], tuple(r["counts"])) for r in rows}
    first, second = tuple(chain.split())[:22], tuple(chain.split())[20:]
    assert paths[first] == (3, (3,) * 20 + (5, 5)) and paths[second] == (3, (5, 5) + (3,) * 28)
    assert paths[("c20", "c21", "other")][0] == 2 and paths[("r", "r", "r")] == (6, (10, 10, 10)) and len(paths) == 4


# ------------------------------------------------------------------ token files
@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=40))
def test_coding(numbers):
    control, data = token_files.encode_ranks(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4) and len(data) == sum(max(1, -(-n.bit_length() // 8)) for n in numbers)
    assert token_files.decode_ranks(control, data, len(numbers)).tolist() == numbers


def test_long_coding():
    numbers = np.random.default_rng(5).integers(0, 2**32, 3 * token_files.CHUNK * 4 + 5, np.uint64) >> np.random.default_rng(6).integers(0, 32, 3 * token_files.CHUNK * 4 + 5, np.uint64)
    assert np.array_equal(token_files.decode_ranks(*token_files.encode_ranks(numbers), len(numbers)), numbers)


def written(rows: list[tuple]) -> list[tuple]:
    """(doc_id, start, n_tokens, crc) in the order of the files."""
    tokenizer, out, start = Tokenizer.from_file(A_FILE), [], 0
    own = []
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        own.append((k is not None, k or 0, len(ids) // 4, zlib.crc32(ids), ids))
    for there, k, n, crc, ids in sorted(own):
        out.append((k if there else None, start, n, crc, ids))
        start += n
    return out


def test_token_files(spark):
    want = [r[:4] for r in written([(d["doc_id"], d["text"]) for d in DOCS])]
    got = registry.QUERIES["op12_token_files"](spark, brute.SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_token_files_of_odd_texts(spark, odd, block):
    path = _files.folder(spark, "test")
    token_files.write_tokens(odd, path, A_FILE, registry.VOCABULARY, 0, block=block)
    got = token_files.read_tokens(spark, path).collect()
    key = lambda r: (r[1], r[0] is not None, r[0] or 0)
    assert sorted([tuple(r) for r in got], key=key) == sorted(written([(k, t) for k, t, _ in ODD]), key=key)
    counts = Counter(np.frombuffer(b"".join(r["ids"] for r in got), "<u4").tolist())
    assert token_files.ids_by_rank(path).tolist() == sorted(counts, key=lambda i: (-counts[i], i))
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert max(r["n_tokens"] for r in blocks) <= max(block, max(r["n_tokens"] for r in got)) and (block == 1) == (len(blocks) == len(ODD))
    empty = _files.folder(spark, "test")
    token_files.write_tokens(odd.where("false"), empty, A_FILE, registry.VOCABULARY, 0)
    assert token_files.read_tokens(spark, empty).count() == 0


# ------------------------------------------------------------------ alignment
def links(rows: list[tuple]) -> list[tuple]:
    tokenizer, model = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    tokenizer.encode_special_tokens = True
    back = {c: b for b, c in alignment.byte_letters().items()}
    spell_a = lambda i: bytes(back[c] for c in tokenizer.id_to_token(i))
    spell_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    met, docs = Counter(), []
    for k, t in rows:
        a = tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(map(spell_a, a)) != want or b"".join(map(spell_b, b)) != want:
            a = b = []
        spans = lambda ids, spell: [(int(e) - len(spell(i)), int(e)) for i, e in zip(ids, np.cumsum([len(spell(i)) for i in ids]))]
        sa, sb = spans(a, spell_a), spans(b, spell_b)
        pairs, first = [], 0
        for i, (x, y) in enumerate(sa):
            while first < len(sb) and sb[first][1] <= x:
                first += 1
            j = first
            while j < len(sb) and sb[j][0] < y:
                pairs.append((a[i], b[j]))
                j += 1
        cuts = sorted({y for _, y in sa} & {y for _, y in sb})
        text, x = [], 0
        for y in cuts:
            text.append("|".join(",".join(str(i) for i, (p, q) in zip(ids, s) if x <= p and q <= y) for ids, s in ((a, sa), (b, sb))) if len(want) < 5000 else "")
            x = y
        met.update(pairs)
        docs.append((k, len(a), len(b), len(cuts), pairs, ";".join(text) if len(want) < 5000 else None))
    best = defaultdict(int)
    for (_, j), n in met.items():
        best[j] = max(best[j], n)
    sha = lambda s: "" if not s else hashlib.sha256(s.encode()).hexdigest()
    return [(k, na, nb, g, len(p), sum(met[x] == best[x[1]] for x in p), sum(met[x] for x in p), None if t is None else sha(t)) for k, na, nb, g, p, t in docs]


def same_links(got: list, want: list) -> None:
    got, want = (sorted(rows, key=lambda r: repr(r[:7])) for rows in (map(tuple, got), want))
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want)) and sum(w[7] is not None for w in want) > len(want) / 2


def test_alignment(spark):
    got = registry.QUERIES["op13_alignment"](spark, brute.SF).collect()
    same_links(got, links([(d["doc_id"], d["text"]) for d in DOCS]))


def test_alignment_of_odd_texts(spark, odd, monkeypatch):
    for name, small in (("SHARD", 64), ("HELD", 100), ("CACHED", 5000), ("AT_ONCE", 200)):
        monkeypatch.setattr(alignment, name, small)
    got = alignment.align(odd.repartition(3), A_FILE, B_FILE).collect()
    want = links([(k, t) for k, t, _ in ODD])
    same_links(got, want)
    zeros = {r["doc_id"] for r in got if r["n_a"] == 0}
    assert zeros == {2, 3, 6, None} and {r["groups_sha256"] for r in got if r["n_a"] == 0} == {""}
    assert alignment.align(odd.where("false"), A_FILE, B_FILE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 40_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**62, n))
    made = alignment.Hash.unpack(alignment.Hash.of(keys).pack())
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    by_number = np.empty(len(keys), np.int64)
    by_number[made(keys)] = keys
    shard = alignment.Shard(alignment.Shard.pack(made.pack(), by_number))
    if n > 1:
        with pytest.raises(ValueError):
            shard.numbers(np.array([2**62 + 1]))


ROUGH = ["a  b", " a", "a ", "a\n\nb", "a\u00a0 b", "a\u2003b", "x\u0085y", "a\tb c", "it's.Mr.X 12,5 a.b ...!", "é.É, ñ;ü", "\x1cq", "a\nb\nc d", "", "q", "日本。語 x", "a \u3000b"]


@pytest.mark.parametrize("before", [b"", b" "])
def test_units(monkeypatch, before):
    """Cut into units, or whole: the same ids, also from a small table that is often made anew."""
    monkeypatch.setattr(_units, "KNOWN", 50)
    monkeypatch.setattr(_units, "SLICE", 3000)
    tokenizer, model = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    tokenizer.encode_special_tokens = True
    a, b = (lambda t: tokenizer.encode(before.decode() + t).ids), model.encode
    texts = ROUGH + [d["text"] or "" for d in DOCS] + ROUGH
    parts = [(_units.byte_level(tokenizer), a), *([(alignment.pieces_of(model), b)] if before else [])]
    got = list(_units.encoded(texts, before, parts))
    assert len(got) == len(texts)
    for t, own in zip(texts, got):
        assert own[0].tolist() == (a(t) if t else []) and (not before or own[1].tolist() == (b(t) if t else []))
    raw = [t.encode() for t in texts]
    fine = _units.plain_texts(texts, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    assert fine.tolist() == [bool(t) and not _units.RUNS.search(t) for t in texts]
