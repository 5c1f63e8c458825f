"""Strings of a fixed length that occur more than once, found on Spark.

A document is a row of symbols (bytes, or words). Every window of ``length``
symbols is filed under its least ``gram``-symbol run by hash (ties: the
leftmost), which depends on the window alone, so equal windows are filed
alike. Neighbouring windows filed under one place make a segment, and a
segment's windows can be repeated only if another segment has its gram:

1. segments of all documents are counted by gram; those whose gram occurs
   twice go on (a bitmap of fixed size thins them where they are read, an exact
   join decides);
2. equal segments are one, with its number; two or more repeat all windows;
3. different segments with one gram are compared in a shard, by the
   operator's own structure (``Kind.verify``); a gram with more than
   ``MANY`` of them is not gathered: its segments are cut again, by a longer
   gram, and what even that leaves with too many is counted window by window.

What is found returns to each document as spans of symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import bitmap, lookup
from ._store import row_key, spread, stage
from ._text import MULTIPLIER, mix, powers, slices, utf8

INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
PLACE = np.uint64((1 << 24) - 1)  # low bits of a filing key: the place in a slice
SLICE = 1 << 20
MANY = 500
FINER = 8  # times fewer windows to a place, for grams with many segments
_powers: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Kind:
    """What the symbols are. ``symbols`` gives a run of documents' symbols, their
    64-bit codes and the documents' offsets in them; ``verify`` gets a
    shard's segments and how often each occurs, and gives a flag for
    each of their windows, one segment after the other."""

    length: int
    gram: int
    dtype: str
    shard: int  # symbols compared at once, or one gram's
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    verify: Callable[[list[np.ndarray], np.ndarray, int], np.ndarray]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        _powers.update(up=powers(n), down=powers(n, INVERSE))
    return _powers["up"][:n], _powers["down"][:n]


def segments(codes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first symbol in it, windows, gram code, content code) of a run's segments."""
    n = len(codes)
    starts = n - length + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if starts <= 0:
        return none
    up, down = power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    wide, have = length - gram + 1, 1
    while have < wide:  # least of ever wider runs of grams
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    inside = np.arange(starts) + length <= offsets[1:][doc]
    place = least[:starts] & PLACE
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = at[new]
    windows = np.diff(np.append(np.flatnonzero(new), len(at)))
    end = first + windows - 1 + length
    content = mix((sums[end] - sums[first]) * down[first] + windows.astype(np.uint64) * MULTIPLIER)
    return doc[first], first - offsets[:-1][doc[first]], windows, grams[place[first].astype(np.int64)], content


def parts(kind: Kind, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, ...]]]:
    """(first document, symbols before the part in a cut document, symbols, segments) over a batch.
    A document of more than a slice is cut into parts that overlap by all but one symbol of a window."""
    for i, j in slices(offsets, SLICE):
        symbols, codes, at = kind.symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if len(symbols) <= 2 * SLICE:
            yield i, 0, symbols, at, segments(codes, at, kind.length, kind.gram)
            continue
        for k in range(0, len(symbols) - kind.length + 1, SLICE):  # one document
            stop = min(k + SLICE + kind.length - 1, len(symbols))
            yield i, k, symbols[k:stop], np.array([0, stop - k]), segments(codes[k:stop], np.array([0, stop - k]), kind.length, kind.gram)


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def both(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A code for a gram and a content together."""
    return mix(h * MULTIPLIER + c)


def find(docs: DataFrame, kind: Kind) -> DataFrame:
    """(x, y, a, n, h, c) for every segment: row key, first symbol, windows, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            for i, before, _, _, (doc, a, n, h, c) in parts(kind, data, offsets):
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), longs(a + before), pa.array(n.astype(np.int32)), longs(h), longs(c)],
                    ["x", "y", "a", "n", "h", "c"],
                )

    return docs.mapInArrow(run, "x long, y long, a long, n int, h long, c long")


def contents(docs: DataFrame, kind: Kind, wanted) -> DataFrame:
    """(h, c, symbols) of the segments that ``wanted`` accepts, each once a task or little more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            data, offsets = utf8(b.column(2))
            for _, _, symbols, at, (doc, a, n, h, c) in parts(kind, data, offsets):
                key = both(h, c)
                at_all = np.flatnonzero(wanted(key))
                _, once = np.unique(key[at_all], return_index=True)
                take = [k for k in at_all[once].tolist() if int(key[k]) not in seen]
                seen = set() if len(seen) > 500_000 else seen
                seen.update(key[take].tolist())
                first = at[:-1][doc] + a
                texts = [symbols[first[k] : first[k] + n[k] - 1 + kind.length].tobytes() for k in take]
                yield pa.RecordBatch.from_arrays([longs(h[take]), longs(c[take]), pa.array(texts, pa.binary())], ["h", "c", "symbols"])

    return docs.mapInArrow(run, "h long, c long, symbols binary")


def compare(shards: DataFrame, kind: Kind) -> DataFrame:
    """(h, c, low, high): runs of repeated windows in segments sorted by gram.
    Whole grams are gathered up to ``kind.shard`` symbols, then compared."""
    unit = np.dtype(kind.dtype).itemsize

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        h, c, m, texts = zip(*rows)
        texts = [np.frombuffer(t, kind.dtype) for t in texts]
        flags = kind.verify(texts, np.array(m, np.int64), kind.length).astype(np.int8)
        of = np.repeat(np.arange(len(texts)), [len(t) - kind.length + 1 for t in texts])
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        edge = np.zeros(len(of) + 1, bool)
        edge[0] = edge[ends] = True
        rise = np.flatnonzero((flags == 1) & (edge[:-1] | (np.concatenate(([0], flags[:-1])) == 0)))
        fall = np.flatnonzero((flags == 1) & (edge[1:] | (np.concatenate((flags[1:], [0])) == 0)))
        base = np.concatenate(([0], ends[:-1]))[of[rise]]
        h, c = np.array(h, np.int64)[of[rise]], np.array(c, np.int64)[of[rise]]
        return pa.RecordBatch.from_arrays([longs(x) for x in (h, c, rise - base, fall - base)], ["h", "c", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in ("h", "c", "m", "symbols"))):
                if held >= kind.shard and row[0] != rows[-1][0]:
                    yield judge(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3]) // unit
        if rows:
            yield judge(rows)

    return shards.mapInArrow(run, "h long, c long, low long, high long")


def window_by_window(rows: DataFrame, kind: Kind) -> DataFrame:
    """As ``compare``, for grams with too many segments to gather: every window is counted by 128 bits of hash."""
    length, unit = kind.length, np.dtype(kind.dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i, t in enumerate(b.column("symbols").to_pylist()):
                codes = np.frombuffer(t, unit).astype(np.uint64)
                k = len(codes) - length + 1
                up, down = power_tables(len(codes) + 1)
                hashes = []
                for salt in (1, 2):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(codes + np.uint64(salt << 40)) * up[: len(codes)])))
                    hashes.append(mix((sums[length:] - sums[:-length]) * down[:k]))
                out.append((np.full(k, i), np.arange(k), *hashes))
            if out:
                of, low, wx, wy = (np.concatenate(v) for v in zip(*out))
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(b.column(v).take(at) for v in ("h", "c", "m")), longs(low), longs(wx), longs(wy)], ["h", "c", "m", "low", "wx", "wy"])

    single = stage(rows.mapInArrow(run, "h long, c long, m long, low long, wx long, wy long"), "windows")
    often = stage(single.groupBy("wx", "wy").agg(F.sum("m").alias("t")).where("t > 1").select("wx", "wy"), "often")
    return single.join(often, ["wx", "wy"]).select("h", "c", "low", F.col("low").alias("high"))


def refine(texts: DataFrame, kind: Kind) -> DataFrame:
    """As ``compare``, for grams with too many segments to gather: they are cut
    into segments of a longer gram, of which the same is asked."""
    gram, length, unit = kind.length - (kind.length - kind.gram) // FINER, kind.length, np.dtype(kind.dtype)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, inside = [], []
            for i, t in enumerate(b.column("symbols").to_pylist()):
                symbols = np.frombuffer(t, unit)
                codes = mix(symbols.astype(np.uint64) + np.uint64(1 << 40))
                _, a, n, h, c = segments(codes, np.array([0, len(codes)]), length, gram)
                out.append((np.full(len(a), i), a, n, h, c))
                inside += [symbols[x : x + k - 1 + length].tobytes() for x, k in zip(a.tolist(), n.tolist())]
            if out:
                of, a, n, h, c = (np.concatenate(v) for v in zip(*out))
                at = pa.array(of)
                columns = [*(b.column(v).take(at) for v in ("h", "c", "m")), longs(a), longs(n), longs(h), longs(c), pa.array(inside, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["oh", "oc", "m", "a", "n", "h", "c", "symbols"])

    parts = stage(texts.mapInArrow(cut, "oh long, oc long, m long, a long, n long, h long, c long, symbols binary"), "finer")
    each = stage(parts.groupBy("h", "c").agg(F.sum("m").alias("m"), F.first("symbols").alias("symbols")), "finer-kinds")
    sizes = stage(each.groupBy("h").agg(F.sum("m").alias("rows"), F.count("*").alias("d")).where("rows > 1").select("h", "d"), "finer-grams")
    each = stage(each.join(sizes, "h"), "finer-kinds")
    few = each.where((F.col("d") > 1) & (F.col("d") <= MANY)).repartition(spread(each, 16), "h").sortWithinPartitions("h", "c")
    whole = each.where("m > 1").select("h", "c", F.lit(0).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))
    ranges = compare(few, kind).union(window_by_window(each.where(F.col("d") > MANY), kind)).union(whole)
    ranges = stage(ranges.groupBy("h", "c").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "finer-runs")
    found = parts.select("oh", "oc", "a", "n", "h", "c").join(ranges, ["h", "c"]).select("oh", "oc", "a", "n", F.explode("runs").alias("r"))
    high = F.col("a") + F.when(F.col("r.high") < 0, F.col("n") - 1).otherwise(F.col("r.high"))
    return found.select(F.col("oh").alias("h"), F.col("oc").alias("c"), (F.col("a") + F.col("r.low")).alias("low"), high.alias("high"))


def repeated_spans(docs: DataFrame, kind: Kind, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(x, y, spans): for each row with a repeated window (by ``row_key``), spans
    [start, end) of symbols that such windows cover; they may overlap."""
    key = row_key(doc_id, text)
    docs = docs.select(key["x"].alias("x"), key["y"].alias("y"), F.col(text).alias("text"))
    sc = docs.sparkSession.sparkContext
    all_ = stage(find(docs, kind), "segments")

    grams = bitmap(all_.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), sc)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(lookup(grams.value, b.column("h").to_numpy().view(np.uint64))))

    some = stage(all_.mapInArrow(thin, all_.schema), "shared")
    kinds = stage(some.groupBy("h", "c").agg(F.count("*").alias("m")), "kinds")
    sizes = stage(kinds.groupBy("h").agg(F.sum("m").alias("rows"), F.count("*").alias("d")).where("rows > 1").select("h", "d"), "grams")
    kinds = stage(kinds.join(sizes, "h"), "kinds")

    # different segments of one gram: their symbols, compared in shards
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c = (b.column(v).to_numpy().view(np.uint64) for v in ("h", "c"))
            yield pa.RecordBatch.from_arrays([longs(both(h, c))], ["h"])

    unlike = kinds.where("d > 1")
    pairs = bitmap(unlike.select("h", "c").mapInArrow(joined, "h long"), sc)
    texts = contents(docs, kind, lambda codes: lookup(pairs.value, codes))
    texts = texts.join(unlike, ["h", "c"]).groupBy("h", "c").agg(F.first("m").alias("m"), F.first("d").alias("d"), F.first("symbols").alias("symbols"))
    texts = stage(texts, "texts")
    few = texts.where(F.col("d") <= MANY).repartition(spread(texts, 16), "h").sortWithinPartitions("h", "c")
    ranges = compare(few, kind).union(refine(texts.where(F.col("d") > MANY), kind))
    # equal segments: all windows (-1: to the end)
    whole = kinds.where("m > 1").select("h", "c", F.lit(0).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))
    ranges = stage(ranges.union(whole).groupBy("h", "c").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "runs")

    span = F.transform(
        "runs", lambda r: F.struct((F.col("a") + r["low"]).alias("start"), (F.col("a") + F.when(r["high"] < 0, F.col("n") - 1).otherwise(r["high"]) + kind.length).alias("end"))
    )
    return some.join(ranges, ["h", "c"]).select("x", "y", span.alias("spans")).groupBy("x", "y").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Flags of ``n`` symbols that the spans cover, and their maximal runs."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    covered = np.cumsum(steps[:-1]) > 0
    return covered, int((covered & ~np.concatenate(([False], covered[:-1]))).sum()) if n else 0
