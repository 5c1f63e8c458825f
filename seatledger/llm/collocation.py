"""Phrase collocation mining on a weighted de Bruijn graph.

Nodes are pairs of words, edges are runs of three words from one pair to the
next, weighted by their occurrences. A task builds the graph of each slice of
text: every word begins one edge, or, where its piece ends first, the one or two
words that are left. What a shorter phrase counts is then its node's flow, the
sum over the edges that leave it, plus the pieces that end on it. A first pass
adds up the flows of words, and finds hot words and pairs (a share of a ``HOT``-th of what a
task should get). The second deals each graph's edges by their first word, a hot word's by
two and a hot pair's by three, as one binary value for each graph and task: the words
once, and edges as their ranks. There edges are added up, and then their nodes'
flow in one run over them; what tasks add to a hot pair is summed once more.

Of that sum, phrases of at least ``min_count`` stay. In their graph a node with
one edge in and one out that both weigh what it counts is inner: no piece begins
or ends there, and no rarer edge meets it. Runs of edges through inner nodes
become one path by pointer doubling (log2 of the longest path's words, rounds; no
cycle can be closed, since the piece that enters one would weigh on the node where
it enters). On a path every edge and every inner node count the same, so
words are looked up once a path, and an inner pair is always part of a phrase
counted as often.

Words are the Spark user's: A-Z lower-cased, texts cut into pieces at
``[.,;:!?\\x0A-\\x0D]`` and those into words at blanks and tabs. A word is known by
64 bits that stand for its language and itself; words themselves travel with
their own counts only.

Defined cases: a null or empty text has no words; a null language is ``und``; ids
are not read; a repeated row counts again; pieces of one word count for that word
alone; an empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import spread, stage
from ._text import LOWER, MULTIPLIER, mix, slices, utf8, word_bounds, word_codes

LONGEST = 3  # words of an edge
WORDS = 1 << 20  # words of the corpus for each task that adds up edges
AT_ONCE = 1 << 20  # words of one local graph: three ranks of them fit 62 bits
SLICE = 4 << 20  # bytes
NO_LANG = "und"
ENDS = np.zeros(256, bool)  # bytes that end a piece
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = ENDS.copy()
BETWEEN[[0x20, 0x09]] = True
W = [f"w{i + 1}" for i in range(LONGEST)]
HOT = 4  # a word, or a pair, is hot from this part of a task's share
OFTEN = 1 << 18  # a pair with this part of a slice's words may be hot
PARTS = 16  # of a language's phrases, ranked apart at first
NONE = np.uint64(0)  # no word


# ------------------------------------------------------------------ local graphs
def longest(ids: np.ndarray, pieces: np.ndarray, count: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs, how often) of what begins at the first ``count`` words: an edge, or the words left
    of a piece. A run is its words' ranks (from 1, below 2 ** ``bits``) in one number."""
    key = np.zeros(count, np.int64)
    for j in range(LONGEST):
        own = np.zeros(count, np.int64)
        n = min(count, max(len(ids) - j, 0))
        own[:n] = np.where(pieces[j : j + n] == pieces[:n], ids[j : j + n] + 1, 0)
        key = key << bits | own
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.diff(np.append(first, count))


def flow(runs: np.ndarray, n: np.ndarray, bits: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the first ``words`` words and their flow: all sorted runs that begin so."""
    part = runs >> bits * (LONGEST - words)
    there = (part & (1 << bits) - 1) > 0
    part, n = part[there], n[there]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    return part[first], np.add.reduceat(n, first) if len(first) else n


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lens = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lens)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, lens)
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


@dataclass
class Slice:
    """Words of some texts: their codes, which piece and language each is of, and where it is."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    pieces: np.ndarray
    lang: np.ndarray
    names: pa.Array
    seeds: np.ndarray

    def parts(self) -> Iterator[tuple[int, int]]:
        for x in range(0, len(self.codes), AT_ONCE - LONGEST):
            yield x, min(x + AT_ONCE - LONGEST, len(self.codes))

    def runs(self, x: int, y: int) -> tuple:
        """(words, first place of each, runs, how often, bits) of the runs that begin at words x to y."""
        unlike, where, ids = np.unique(self.codes[x : y + LONGEST - 1], return_index=True, return_inverse=True)
        bits = len(unlike).bit_length()
        return unlike, where + x, *longest(ids, self.pieces[x : y + LONGEST - 1], y - x, bits), bits


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """Columns lang, text."""
    for b in batches:
        langs = b.column(0).fill_null(NO_LANG).dictionary_encode()
        names, of = langs.dictionary.cast(pa.string()), langs.indices.to_numpy()
        seeds = [word_codes(np.frombuffer(x.encode() + b"\0", np.uint8), np.array([0]), np.array([len(x.encode()) + 1]))[0] for x in names.to_pylist()]
        seeds, (raw, at) = np.array(seeds, np.uint64), utf8(b.column(1))
        for i, j in slices(at, SLICE):
            data, own = LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i]
            starts, ends, doc = word_bounds(data, own, BETWEEN)
            if len(starts):
                lang = of[i:j][doc]
                codes = np.maximum(mix(word_codes(data, starts, ends) * MULTIPLIER + seeds[lang]), np.uint64(1))
                # a word that follows the end of a piece, or begins a document, begins a piece
                stops = np.concatenate(([0], np.cumsum(ENDS[data])))[starts]
                pieces = np.cumsum(np.concatenate(([True], (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1]))))
                yield Slice(data, starts, ends, codes, pieces, lang, names, seeds)


def words_of(runs: np.ndarray, words: int, bits: int) -> list[np.ndarray]:
    """The ranks of each word of runs of ``words`` words; 0 behind the last."""
    return [runs >> bits * (words - 1 - k) & (1 << bits) - 1 for k in range(words)]


def node_code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * MULTIPLIER + second)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ------------------------------------------------------------------ first pass
def word_flows(docs: DataFrame) -> DataFrame:
    """(w, lang, word, n): all words with their counts, the words of each language (no ``word``),
    and pairs that are common in a slice (``w`` is the pair's code; neither)."""

    def rows(w: np.ndarray, n: np.ndarray, lang: pa.Array | None = None, word: pa.Array | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(n), pa.string())
        columns = [pa.array(w.view(np.int64)), none if lang is None else lang, none if word is None else word, pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["w", "lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in read(batches):
            total = np.bincount(s.lang, minlength=len(s.names))
            met = np.flatnonzero(total)
            yield rows(s.seeds[met], total[met], s.names.take(pa.array(met)))
            for x, y in s.parts():
                unlike, where, runs, n, bits = s.runs(x, y)
                single, times = flow(runs, n, bits, 1)
                first = where[single - 1]
                yield rows(unlike[single - 1], times, s.names.take(pa.array(s.lang[first])), strings(s.data, s.starts[first], s.ends[first]))
                pairs, times = flow(runs, n, bits, 2)
                often = times * OFTEN > y - x
                a, b = words_of(pairs[often], 2, bits)
                yield rows(node_code(unlike[a - 1], unlike[b - 1]), times[often])

    local = docs.mapInArrow(run, "w long, lang string, word string, n long")
    return local.groupBy("w", "lang", "word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ second pass
def pack(ranks: list[np.ndarray], n: np.ndarray, codes: np.ndarray) -> bytes:
    """Edges as ranks (from 1; 0: none) among ``codes``, sorted -> bytes: the words that occur, once, and then the edges."""
    met = np.zeros(len(codes) + 1, bool)
    for r in ranks:
        met[r] = True
    met[0] = True
    own, known = np.cumsum(met) - 1, codes[np.flatnonzero(met[1:])]
    kind = "<u2" if len(known) < 1 << 16 else "<u4"
    first = np.diff(own[ranks[0]], prepend=0)
    count = "u1" if n.max(initial=0) < 1 << 8 else "<u8"
    parts = [first.astype(kind), *(own[r].astype(kind) for r in ranks[1:]), n.astype(count)]
    return struct.pack("<QQ??", len(known), len(n), kind == "<u2", count == "u1") + known.astype("<u8").tobytes() + b"".join(p.tobytes() for p in parts)


def unpack(raw: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words, ranks among them, counts)."""
    words, size, short, small = struct.unpack_from("<QQ??", raw)
    at = struct.calcsize("<QQ??")
    known = np.frombuffer(raw, "<u8", words, at)
    at, kind, out = at + 8 * words, "<u2" if short else "<u4", []
    for _ in range(LONGEST):
        out.append(np.frombuffer(raw, kind, size, at).astype(np.int64))
        at += size * (2 if short else 4)
    out[0] = np.cumsum(out[0])
    return known, out, np.frombuffer(raw, "u1" if small else "<u8", size, at).astype(np.int64)


def deal_edges(docs: DataFrame, tasks: int, hot: np.ndarray) -> DataFrame:
    """(p, edges) of each local graph, for ``tasks`` numbers ``p``; ``hot``: codes of hot words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in read(batches):
            for x, y in s.parts():
                unlike, _, runs, n, bits = s.runs(x, y)
                known = np.concatenate(([NONE], unlike))
                ranks = words_of(runs, LONGEST, bits)
                pair = ranks[1] > 0  # a word that is a piece by itself leaves no node
                ranks, n = [r[pair] for r in ranks], n[pair]
                a, b, c = (known[r] for r in ranks)
                node = node_code(a, b)
                deal = np.where(np.isin(known, hot)[ranks[0]], node, mix(a))
                deal = np.where(np.isin(node, hot), mix(node * MULTIPLIER + c), deal) % np.uint64(tasks)
                order = np.argsort(deal.astype(np.uint32), kind="stable")
                deal = deal[order].astype(np.int32)
                first = heads(deal) if len(deal) else np.zeros(0, np.int64)
                parts = np.split(order, first[1:]) if len(deal) else []
                yield pa.RecordBatch.from_arrays([pa.array(deal[first]), pa.array([pack([r[at] for r in ranks], n[at], unlike) for at in parts], pa.binary())], ["p", "edges"])

    return docs.mapInArrow(run, "p int, edges binary")


def add_up(dealt: DataFrame, min_count: int, hot: np.ndarray) -> DataFrame:
    """(w1, w2, w3, n): edges, and nodes with their flow (no ``w3``). Those below
    ``min_count`` go, but for a hot pair's, which other tasks add to."""

    def sums(values: list[bytes]) -> pa.RecordBatch:
        parts = [unpack(v) for v in values]
        words = np.unique(np.concatenate([known for known, _, _ in parts]))
        n, bits = np.concatenate([x for _, _, x in parts]), len(words).bit_length()
        own = [np.concatenate(([0], np.searchsorted(words, known) + 1)) for known, _, _ in parts]
        a, b, c = (np.concatenate([m[ranks[k]] for m, (_, ranks, _) in zip(own, parts)]) for k in range(LONGEST))
        order = np.argsort(a << 2 * bits | b << bits | c) if LONGEST * bits < 64 else np.lexsort((c, b, a))
        a, b, c, n = a[order], b[order], c[order], n[order]
        edge, node = heads(a, b, c), heads(a, b)
        weight, flows = np.add.reduceat(n, edge), np.add.reduceat(n, node)
        known = np.concatenate(([NONE], words))
        edge, weight = (x[(c[edge] > 0) & (weight >= min_count)] for x in (edge, weight))
        often = (flows >= min_count) | np.isin(node_code(known[a[node]], known[b[node]]), hot)
        node, flows = node[often], flows[often]
        at = np.concatenate((edge, node))
        last = np.concatenate((known[c[edge]], np.zeros(len(node), np.uint64)))
        columns = [known[a[at]], known[b[at]], last, np.concatenate((weight, flows))]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in columns], [*W, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            for p, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and p != own:
                    yield sums(held)
                    held = []
                own = p
                held.append(value.as_py())
        if held:
            yield sums(held)

    return dealt.mapInArrow(run, "w1 long, w2 long, w3 long, n long")


def phrase_counts(docs: DataFrame, min_count: int, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), (w, lang, word, n) and (w1, w2, w3, n), staged: each language's words, and
    the words, pairs (no ``w3``) and triples counted at least ``min_count`` times."""
    docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    kept = (F.col("n") >= min_count) | F.col("word").isNull()
    words = stage(word_flows(docs).where(kept), "words")
    totals = words.where(F.col("lang").isNotNull() & F.col("word").isNull()).select("lang", "n")
    size = totals.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-size // WORDS))
    # no more of either than HOT times the tasks
    hot = words.where((F.col("word").isNotNull() | F.col("lang").isNull()) & (F.col("n") * HOT * tasks > size)).select("w").toPandas()["w"]
    hot = np.unique(hot.to_numpy(np.int64).view(np.uint64))
    dealt = deal_edges(docs, tasks, hot).repartition(spread(docs, 2 * tasks), "p").sortWithinPartitions("p")
    grams = add_up(dealt, min_count, hot).groupBy(*W).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    grams = stage(grams.withColumn("w3", F.when(F.col("w3") != 0, F.col("w3"))), "phrases")
    return totals, words.where(F.col("word").isNotNull()), grams


# ------------------------------------------------------------------ paths
def inner_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs: x, y, n, ``most`` (their heaviest edge), and, for an inner one, the
    ids of its edges, ``before`` and ``after`` (else null)."""
    side = lambda x, y, name: edges.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.count("*").alias(f"{name}s"), F.max("n").alias(f"{name}_n"), F.max("id").alias(name)
    )
    met = nodes.select(F.col("w1").alias("x"), F.col("w2").alias("y"), "n").join(side("w2", "w3", "before"), ["x", "y"], "left").join(side("w1", "w2", "after"), ["x", "y"], "left")
    inner = (F.col("befores") == 1) & (F.col("afters") == 1) & (F.col("before_n") == F.col("n")) & (F.col("after_n") == F.col("n"))
    only = lambda name: F.when(inner, F.col(name)).alias(name)
    return met.select("x", "y", "n", F.greatest("before_n", "after_n").alias("most"), only("before"), only("after"))


def places(links: DataFrame) -> DataFrame:
    """links (before, after): id, head, at. Each id's first on its path and how many
    links lie between, by pointer doubling; heads themselves are left out."""
    now = stage(links.select(F.col("after").alias("id"), F.col("before").alias("head"), F.lit(1).cast("long").alias("at")), "links")
    while True:
        ahead = now.select(F.col("id").alias("head"), F.col("head").alias("further"), F.col("at").alias("more"))
        moved = now.join(ahead, "head", "left")
        moved = stage(moved.select("id", F.coalesce("further", "head").alias("head"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"), F.col("further").isNotNull().alias("moved")), "links")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        now = moved.drop("moved")


def compact_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """path, n, codes: the words of each path in their order. Every edge is on one path."""
    on = edges.join(places(pairs.where(F.col("after").isNotNull())), "id", "left")
    head, at = F.coalesce("head", "id").alias("path"), F.coalesce("at", F.lit(0))
    # a head brings its first two words, every edge its last
    brings = F.when(F.col("head").isNull(), F.array(*[F.struct((at + i).alias("at"), F.col(w).alias("w")) for i, w in enumerate(W)]))
    brings = F.coalesce(brings, F.array(F.struct((at + LONGEST - 1).alias("at"), F.col(W[-1]).alias("w"))))
    grouped = on.select(head, "n", brings.alias("own")).groupBy("path").agg(F.max("n").alias("n"), F.sort_array(F.flatten(F.collect_list("own"))).alias("own"))
    return grouped.select("path", "n", F.transform("own", lambda x: x["w"]).alias("codes"))


# ------------------------------------------------------------------ collocations
def score_of(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in 38 digits."""
    return F.expr(f"(cast({a} as decimal(18,0)) * cast({a} as decimal(18,0)) * 1000000) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")


def phrase_graph(docs: DataFrame, min_count: int, lang: str = "lang", text: str = "text") -> dict[str, DataFrame]:
    """``totals`` (lang, n), ``words`` (w, lang, word, n), ``pairs`` (see ``inner_nodes``)
    and ``paths`` (path, n, lang, words, counts: each word's count) of the graph."""
    totals, words, grams = phrase_counts(docs, min_count, lang, text)
    edges = stage(grams.where(F.col("w3").isNotNull()).select(F.monotonically_increasing_id().alias("id"), *W, "n"), "edges")
    pairs = stage(inner_nodes(edges, grams.where(F.col("w3").isNull())), "pairs")
    paths = compact_paths(edges, pairs)
    met = paths.select("path", "n", F.posexplode("codes").alias("at", "w")).join(words.withColumnRenamed("n", "count"), "w")
    own = F.sort_array(F.collect_list(F.struct("at", "w", "word", "count"))).alias("own")
    paths = met.groupBy("path").agg(F.max("n").alias("n"), F.max("lang").alias("lang"), own)
    part = lambda name: F.transform("own", lambda x: x[name])
    paths = paths.select("path", "n", "lang", part("w").alias("codes"), part("word").alias("words"), part("count").alias("counts"))
    return {"totals": totals, "words": words, "pairs": pairs, "paths": stage(paths, "paths")}


def collocations(docs: DataFrame, min_count: int = 10, share: int = 50, first: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases of two
    and three words counted at least ``min_count`` times, cut where they score least;
    phrases inside a longer one counted ``share`` percent as often are left out."""
    graph = phrase_graph(docs, min_count, lang, text)
    words, pairs, paths = graph["words"], graph["pairs"], graph["paths"]

    # triples: counts of the pairs inside are the path's, but for the pairs at its ends
    end = pairs.select("x", "y", F.col("n").alias("end"))
    codes = F.col("codes")
    size = F.size(codes)
    paths = paths.withColumns({"x": codes[0], "y": codes[1]}).join(end.withColumnRenamed("end", "low"), ["x", "y"]).drop("x", "y")
    paths = paths.withColumns({"x": F.element_at(codes, -2), "y": F.element_at(codes, -1)}).join(end.withColumnRenamed("end", "high"), ["x", "y"]).drop("x", "y")
    triple = F.transform(
        F.sequence(F.lit(0), size - LONGEST),
        lambda i: F.struct(
            F.concat_ws(" ", F.slice("words", i + 1, LONGEST)).alias("phrase"),
            F.get("counts", i).alias("l1"),
            F.when(i == size - LONGEST, F.col("high")).otherwise(F.col("n")).alias("r1"),
            F.when(i == 0, F.col("low")).otherwise(F.col("n")).alias("l2"),
            F.get("counts", i + 2).alias("r2"),
        ),
    )
    triples = paths.select("lang", F.col("n").alias("a"), F.explode(triple).alias("t")).select("lang", "a", "t.*")
    triples = triples.withColumns({"s1": score_of("a", "l1", "r1"), "s2": score_of("a", "l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    cut = lambda k: F.when(early, F.col(f"{k}1")).otherwise(F.col(f"{k}2")).alias(k)
    triples = triples.select("lang", "phrase", "a", cut("l"), cut("r"), F.least("s1", "s2").alias("score"))

    # pairs: an inner one is part of a triple that counts the same
    kept = pairs.where(F.col("after").isNull() & (F.coalesce(F.col("most"), F.lit(0)) * 100 < F.col("n") * share))
    one = lambda at, name: words.select(F.col("w").alias(at), F.col("word").alias(f"{name}_word"), F.col("n").alias(name), *(["lang"] if at == "x" else []))
    twos = kept.join(one("x", "l"), "x").join(one("y", "r"), "y").withColumnRenamed("n", "a")
    twos = twos.select("lang", F.concat_ws(" ", "l_word", "r_word").alias("phrase"), "a", "l", "r", score_of("a", "l", "r").alias("score"))

    # the first of each part of a language, and then of the language: no task reads more than first * PARTS rows of one
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    ranked = triples.unionByName(twos).withColumn("part", part)
    for by in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = graph["totals"].withColumnRenamed("n", "total")  # one row a language
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
