"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, A-Z lower-cased. A document and a
benchmark item meet if they share a seed (``min_words`` consecutive words);
then running Karp-Rabin marks, again and again, the longest matches that do
not overlap a marked one, so a passage whose parts come in another order is
still covered. A document is contaminated if the tiles cover at least
``coverage`` of some item's words.

A document that covers an item so far must share one of the item's rare
seeds: the item's most frequent seeds (by how many items have them) are left
out as long as all they lie over is short of the coverage. A phrase found in
every document and every item therefore brings no pair together unless it
alone would do. Documents are tested against a bitmap of the rare seeds, of a
fixed size whatever the benchmark's; only those that hit it go on, and an exact
join follows. Of the pairs that meet, those are tiled whose shared seeds, rare
or not, lie over enough words. A document's pairs are dealt to ``SHARES`` rows.

Defined cases: null and empty texts and items match nothing, nor do items of
fewer than ``min_words`` words; equal items with several ids count each;
repeated document rows share one result; null ids are carried. An empty table
on either side leaves documents clean. Result columns replace input columns
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import bitmap, lookup
from ._store import plain, plus, row_key, stage
from ._text import LOWER, MARK, MULTIPLIER, gram_codes, powers, slices, utf8, word_bounds, word_codes

MIN_WORDS = 5
COVERAGE = 0.8
SLICE = 1 << 18
SHARES = 64
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


# ------------------------------------------------------------------ tiling
def run_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin codes of all runs of ``n`` words, from prefix sums."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers(len(codes)))))
    return (sums[n:] - sums[:-n]) * powers(len(codes), INVERSE)[: len(codes) - n + 1]


def free_runs(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of ``n`` words of which none is marked."""
    used = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(used[n:] == used[:-n])


def scan(item: np.ndarray, doc: np.ndarray, in_item: np.ndarray, in_doc: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches (length, item start, document start) of at least ``n`` words."""
    if n > min(len(item), len(doc)):
        return []
    at_item, at_doc = free_runs(in_item, n), free_runs(in_doc, n)
    codes_item, codes_doc = run_codes(item, n)[at_item], run_codes(doc, n)[at_doc]
    order = np.argsort(codes_item, kind="stable")
    low, high = (np.searchsorted(codes_item[order], codes_doc, side) for side in ("left", "right"))
    out = []
    for k in np.flatnonzero(high > low):
        d = int(at_doc[k])
        for i in at_item[order[low[k] : high[k]]].tolist():
            if i and d and item[i - 1] == doc[d - 1] and not (in_item[i - 1] or in_doc[d - 1]):
                continue  # a longer match began before
            most = min(len(item) - i, len(doc) - d)
            stop = (item[i : i + most] != doc[d : d + most]) | in_item[i : i + most] | in_doc[d : d + most]
            length = int(stop.argmax()) if stop.any() else most
            if length >= n:
                out.append((length, i, d))
    return out


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_WORDS, first: int = 20) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item start, document start): the search length
    starts at ``first``, rises while much longer matches show, and is halved
    down to ``least``."""
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out, n = [], max(first, least)
    while True:
        found = scan(item, doc, in_item, in_doc, n)
        longest = max((x[0] for x in found), default=0)
        if longest > 2 * n:
            n = longest
            continue
        again = False
        for length, i, d in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if in_item[i : i + length].any() or in_doc[d : d + length].any():
                again = True  # what is left of it shows in the next scan
                continue
            in_item[i : i + length] = in_doc[d : d + length] = True
            out.append((length, i, d))
        if again:
            continue
        if n == least:
            return out
        n = max(n // 2, least)


# ------------------------------------------------------------------ operator
def word_lists(rows: DataFrame, text: str, keep=None) -> DataFrame:
    """All columns but the text, plus the words' codes; with ``keep`` (codes of
    the seeds to booleans) only texts with a seed that it accepts."""
    rest = rows.drop(text)
    names, where = rest.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(where))
            others = pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != where], names)
            for i, j in slices(offsets, SLICE):
                part = LOWER[data[offsets[i] : offsets[j]]]
                starts, ends, doc = word_bounds(part, offsets[i : j + 1] - offsets[i], MARK)
                codes, cuts = word_codes(part, starts, ends), np.searchsorted(doc, np.arange(j - i + 1))
                stays = np.arange(j - i)
                if keep is not None:
                    n = max(len(doc) - MIN_WORDS + 1, 0)  # runs of MIN_WORDS words; a slice may have fewer words
                    inside = doc[:n] == doc[MIN_WORDS - 1 :]
                    stays = np.unique(doc[:n][inside & keep(gram_codes(codes, MIN_WORDS))])
                chosen = np.zeros(j - i, bool)
                chosen[stays] = True
                lens = np.diff(cuts)[stays]
                lists = pa.ListArray.from_arrays(
                    np.concatenate(([0], np.cumsum(lens))).astype(np.int32), codes[chosen[doc]].view(np.int64)
                )
                yield pa.RecordBatch.from_arrays([*others.take(pa.array(stays + i)).columns, lists], [*names, "codes"])

    return rows.mapInArrow(run, plus(rest.schema, codes="array<long>"))


def seeds(rows: DataFrame, keep=None) -> DataFrame:
    """(x, y, seed): each row's distinct seeds, with ``keep`` those it accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, lists = (b.column(c) for c in ("x", "y", "codes"))
            got = [np.unique(gram_codes(codes.values.to_numpy().view(np.uint64), MIN_WORDS)) for codes in lists]
            if keep is not None:
                got = [g[keep(g)] for g in got]
            if got:
                at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                yield pa.RecordBatch.from_arrays([x.take(at), y.take(at), pa.array(np.concatenate(got).view(np.int64))], ["x", "y", "seed"])

    return rows.select("x", "y", "codes").mapInArrow(run, "x long, y long, seed long")


def over_words(by_seed: np.ndarray, least: bool) -> np.ndarray:
    """For each word the least (or the highest) value of the seeds that lie over it."""
    fill = np.iinfo(np.int64).max if least else 0
    edge = np.full(MIN_WORDS - 1, fill, np.int64)
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate((edge, by_seed.astype(np.int64), edge)), MIN_WORDS)
    return near.min(1) if least else near.max(1)


def needed(words: int, coverage: float) -> int:
    """Words of an item that tiles must cover."""
    return max(int(np.ceil(words * coverage - 1e-9)), 1)


def rare(codes: np.ndarray, common: np.ndarray, items: np.ndarray, coverage: float) -> np.ndarray:
    """The seeds of an item of which a document that covers it must have one.
    ``common`` (ascending) are seeds of more than one item, ``items`` how many
    have them. The others together lie over fewer words than are needed."""
    need = needed(len(codes), coverage)
    if need > len(codes):
        return np.zeros(0, np.uint64)
    kinds, first, of = np.unique(gram_codes(codes, MIN_WORDS), return_index=True, return_inverse=True)
    often = np.ones(len(kinds), np.int64)
    often[np.searchsorted(kinds, common)] = items
    place = np.empty(len(kinds), np.int64)
    place[np.lexsort((first, -often))] = np.arange(len(kinds))
    return kinds[place >= np.sort(over_words(place[of], least=True))[need - 1]]


def rare_seeds(items: DataFrame, coverage: float) -> DataFrame:
    """(x, y, seed): the rare seeds of each item."""
    every = seeds(items)
    common = every.groupBy("seed").agg(F.count("*").alias("items")).where("items > 1")
    # one item's seeds: as long as its text
    known = every.join(common, "seed").groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("seed", "items"))).alias("common"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for codes, found in zip(b.column("codes"), b.column("common")):
                seed, items = (np.array([], np.int64),) * 2
                if found.is_valid:
                    seed, items = (found.values.field(c).to_numpy() for c in ("seed", "items"))
                seed = seed.view(np.uint64)
                order = np.argsort(seed)
                got.append(rare(codes.values.to_numpy().view(np.uint64), seed[order], items[order], coverage))
            if got:
                at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                seed = pa.array(np.concatenate(got).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("x").take(at), b.column("y").take(at), seed], ["x", "y", "seed"])

    rows = items.select("x", "y", "codes").join(known, ["x", "y"], "left")
    return rows.mapInArrow(run, "x long, y long, seed long")


def met(near: DataFrame, item_seeds: DataFrame, keep=None) -> DataFrame:
    """(x, y, ix, iy): documents and items that share a rare seed."""
    return seeds(near, keep).join(item_seeds.select(F.col("x").alias("ix"), F.col("y").alias("iy"), "seed"), "seed").select("x", "y", "ix", "iy").distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(x, y, items, coverage) for each contaminated row: ``x``, ``y`` its
    ``row_key``, the items' ids and the best coverage."""
    item_key = row_key(item_id, item_text)
    items = benchmark.select(item_key["x"].alias("x"), item_key["y"].alias("y"), F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    items = stage(word_lists(items.dropDuplicates(["x", "y"]), "text"), "items").where(F.size("codes") >= MIN_WORDS)
    item_seeds = stage(rare_seeds(items, coverage), "seeds")
    bits = bitmap(item_seeds.select("seed"), docs.sparkSession.sparkContext)

    def keep(codes: np.ndarray) -> np.ndarray:
        return lookup(bits.value, codes)

    key = row_key(doc_id, text)
    near = docs.select(key["x"].alias("x"), key["y"].alias("y"), F.col(text).alias("text"))
    near = stage(word_lists(near, "text", keep), "near").dropDuplicates(["x", "y"])
    passages = items.select(F.col("x").alias("ix"), F.col("y").alias("iy"), "item", F.col("codes").alias("words"))
    share = F.pmod("ix", F.lit(SHARES)).alias("share")
    sets = met(near, item_seeds, keep).join(passages, ["ix", "iy"]).groupBy("x", "y", share).agg(F.collect_list(F.struct("item", "words")).alias("sets"))
    kind = benchmark.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, codes, sets in zip(*(b.column(c) for c in ("x", "y", "codes", "sets"))):
                doc, found, best = codes.values.to_numpy().view(np.uint64), [], 0.0
                grams = np.unique(gram_codes(doc, MIN_WORDS))
                for s in sets:
                    words = s["words"].values.to_numpy().view(np.uint64)
                    shared = np.isin(gram_codes(words, MIN_WORDS), grams)
                    if over_words(shared, least=False).sum() < needed(len(words), coverage):
                        continue
                    part = sum(t[0] for t in tiles(words, doc)) / len(words)
                    if part >= coverage:
                        found.append(s["item"].as_py())
                        best = max(best, part)
                if found:
                    out.append((x.as_py(), y.as_py(), found, best))
            names = ["x", "y", "items", "coverage"]
            kinds = [pa.int64(), pa.int64(), b.schema.field("sets").type.value_type.field("item").type, pa.float64()]
            kinds[2] = pa.list_(kinds[2])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names)

    found = near.join(sets, ["x", "y"]).select("x", "y", "codes", "sets")
    parts = found.mapInArrow(run, f"x long, y long, items array<{kind}>, coverage double")
    every = F.array_sort(F.flatten(F.collect_list("items"))).alias("items")  # nulls last
    return stage(parts.groupBy("x", "y").agg(every, F.max("coverage").alias("coverage")), "leaks")


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text plus ``contaminated``, ``items`` and ``coverage`` (0 where clean)."""
    docs = plain(docs)
    leaks = contamination(docs, benchmark, coverage, doc_id, text).withColumnsRenamed({"x": "__x", "y": "__y"})
    key, names = row_key(doc_id, text), ("contaminated", "items", "coverage")
    kind = leaks.schema["items"].dataType
    return (
        docs.drop(*names).withColumns({"__x": key["x"], "__y": key["y"]}).drop(text).join(leaks, ["__x", "__y"], "left")
        .withColumn("contaminated", F.col("items").isNotNull())
        .withColumn("items", F.coalesce("items", F.array().cast(kind))).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
        .drop("__x", "__y")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The clean rows of ``docs``."""
    docs = plain(docs)
    leaks = contamination(docs, benchmark, coverage, doc_id, text).select(F.col("x").alias("__x"), F.col("y").alias("__y"))
    key = row_key(doc_id, text)
    return docs.withColumns({"__x": key["x"], "__y": key["y"]}).join(leaks, ["__x", "__y"], "left_anti").select(*docs.columns)
