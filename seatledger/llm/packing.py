"""Best-fit packing with Martello-Toth dominance reduction.

Sizes are whole numbers of at most ``capacity`` tokens, so the instance is a
histogram of at most ``capacity`` counts, however large the corpus: Spark
tokenizes, counts pieces by size and ranks them within their size; the
reduction and best fit run on the histogram, and what they return is a list of
patterns (sizes that share a sequence, and how often), which each piece finds
its place in by its size and rank.

Defined cases: a null text is empty, and an empty text is the end token alone;
repeated rows are packed each; nulls in the id are carried; an empty table
gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import plus, spread, stage
from ._units import byte_level, encoded, in_slices

Patterns = list[tuple[int, tuple[int, ...]]]


# ------------------------------------------------------------------ tokens
_tables: dict[str, tuple] = {}


def table(path: str) -> tuple:
    """(units, what encodes a whole text, special tokens) of a tokenizer file; one for each worker."""
    if path not in _tables:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _tables[path] = byte_level(tokenizer, np.uint32), (lambda s: tokenizer.encode(s, add_special_tokens=False).ids), special
    return _tables[path]


def token_ids(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """Each text's ids, unsigned 32-bit."""
    units, whole, special = table(path)
    # a special token's string is that token, wherever it stands
    marked = {k for k, t in enumerate(texts) if any(s in t for s in special)}
    plain = ["" if k in marked else t for k, t in enumerate(texts)] if marked else texts
    for k, (ids,) in enumerate(encoded(plain, b"", [(units, whole)])):
        yield np.array(whole(texts[k]), np.uint32) if k in marked else ids


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    return next(token_ids([text], path)).astype("<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents of more than ``capacity``
    tokens cut into pieces of that many, of which the first may be shorter."""
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1):
            of, out = [], []
            for i, own in enumerate(token_ids(b.column(1).fill_null("").to_pylist(), tokenizer)):
                ids = own.astype("<u4").tobytes() + last
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    of.append(i)
                    out.append((k, x, y - x, zlib.crc32(memoryview(ids)[4 * x : 4 * y])))
            columns = zip(*out) if out else [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------------------ patterns
def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Patterns, dict[int, int]]:
    """Fixes sets that dominate every other set with their largest item.

    For an item of size s with room r beside it, and k the largest other item
    that fits: with no such item {s} is alone; {s, k} dominates if k = r, or if
    no two or more other items in r sum to more than k (each such set could
    take k's place elsewhere). Returns the fixed patterns and what is left.
    """
    left = {s: n for s, n in counts.items() if n}
    fixed: Patterns = []
    for s in sorted(left, reverse=True):
        while left.get(s):
            left[s] -= 1  # the item itself does not stand beside itself
            room = capacity - s
            fits = [x for x, n in left.items() if n and x <= room]
            left[s] += 1
            k = max(fits, default=0)
            if k and k < room and best_sum(fits, left, room, s) > k:
                break
            if not k:
                n, pattern = left[s], (s,)
            elif k == s:
                n, pattern = left[s] // 2, (s, s)
            else:
                n, pattern = min(left[s], left[k]), (s, k)
            fixed.append((n, pattern))
            for x in pattern:
                left[x] -= n
    return fixed, {s: n for s, n in left.items() if n}


def best_sum(fits: list[int], left: dict[int, int], room: int, own: int) -> int:
    """The largest sum of two or more of the items that stays within ``room`` (0: none)."""
    # bit x of reach[j]: some j (0, 1, 2 or more) items sum to x
    reach, all_ = [1, 0, 0], (1 << room + 1) - 1
    for x in fits:
        for _ in range(min(left[x] - (x == own), room // x)):
            reach = [reach[0], reach[1] | 1 << x, (reach[2] | (reach[1] | reach[2]) << x) & all_]
    return reach[2].bit_length() - 1 if reach[2] else 0


def best_fit(counts: dict[int, int], capacity: int) -> Patterns:
    """Best fit in decreasing order, equal items and equal sequences at once."""
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n and (room := min((r for r in rooms if r >= s and rooms[r]), default=0)):
            many, pattern = rooms[room].pop()
            now = min(n, many)
            if many > now:
                rooms[room].append((many - now, pattern))
            rooms[room - s].append((now, (*pattern, s)))
            n -= now
        each = capacity // s
        for many, size in ((n // each, each), (int(n % each > 0), n % each)):
            if many:
                rooms[capacity - s * size].append((many, (s,) * size))
    return [x for r in rooms.values() for x in r]


def plan(counts: dict[int, int], capacity: int) -> Patterns:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: Patterns) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: first ranks, sequence number of the first rank, offset."""
    out, used, sequence = defaultdict(list), defaultdict(int), 0
    for n, pattern in patterns:
        offset = 0
        for s in pattern:
            out[s].append((used[s], sequence, offset))
            used[s] += n
            offset += s
        sequence += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in out.items()}


# ------------------------------------------------------------------ operator
def pack(docs: DataFrame, tokenizer: str, capacity: int, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents plus ``sequence_id`` and ``offset``."""
    cut = stage(pieces(docs, tokenizer, capacity, end, doc_id, text), "pieces")
    # at most ``capacity`` rows, whatever the input
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = slots(plan(counts, capacity))
    buckets = spread(cut, sum(counts.values()) // 20_000)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = cut.withColumn("within", F.row_number().over(inside) - 1).join(firsts.drop("n"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("within")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for s, at in zip(*(lambda u: (u[0], np.split(order, u[1][1:])))(np.unique(size[order], return_index=True))):
                firsts, sequences, offsets = place[int(s)]
                which = np.searchsorted(firsts, rank[at], "right") - 1
                sequence[at], offset[at] = sequences[which] + rank[at] - firsts[which], offsets[which]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, plus(ranked.drop("rank").schema, sequence_id="long", offset="long"))
