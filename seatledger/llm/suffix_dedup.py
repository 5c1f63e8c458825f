"""Suffix-array dedup: bytes of long repeated strings go.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else, in the same document or another, judged on the input. Segments
that may hold such strings meet in shards (``_repeats``); a shard's suffixes
are sorted by a little more than ``length`` bytes, and threshold-bounded
interval expansion on its Burrows-Wheeler transform gives the common prefixes
of neighbours by increasing value: breadth first, every interval of a string w
is extended backward by each byte before it, and the end of a new interval, if
no shorter string has set it, gets the common prefix |w|. After ``length``
rounds the expansion stops; what is still unset is a neighbour with a common
prefix of ``length`` or more. Each entry is set once, so the work is in
proportion to the shard.

Defined cases: a null text counts as empty; texts shorter than ``length``
keep everything; repeated rows are documents of their own, so they lose what
they share; matches never cross documents; nulls and other columns are
carried; an empty table gives an empty table. Kept bytes may end within a
character, so they are returned as binary. Result columns replace input
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._repeats import Kind, cover, repeated_spans
from ._store import plain, plus, row_key
from ._text import BYTE_CODE, utf8


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by at least their first ``depth``
    symbols (values below 512, of which the last occurs once), by doubling."""
    n, have = len(text), 7
    rank = np.zeros(n, np.int64)
    padded = np.concatenate((text.astype(np.int64), np.zeros(have, np.int64)))
    for i in range(have):  # seven symbols of nine bits
        rank = (rank << 9) | padded[i : i + n]
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.concatenate(([0], rank[order][1:] != rank[order][:-1]))
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new)
        if have >= depth or dense[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - have, 0)] = dense[have:] + 1
        rank = dense * (n + 1) + after
        have *= 2


def bounded_prefixes(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """Common prefix of each suffix and its left neighbour in ``order``, or
    ``bound`` if it is that or more."""
    n = len(text)
    before = text[order - 1]  # the Burrows-Wheeler transform; position 0 wraps round
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)  # last to first
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    previous, following = np.full(n, -1), np.full(n, n)
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    common = np.full(n + 1, -1)
    common[0] = 0  # no left neighbour
    low, high = np.array([0]), np.array([n])
    for length in range(bound):
        lens = high - low
        of = np.repeat(np.arange(len(low)), lens)
        at = np.arange(len(of)) - np.repeat(np.cumsum(lens) - lens, lens) + low[of]
        # the first and the last place of each symbol in each interval
        first, last = at[previous[at] < low[of]], at[following[at] >= high[of]]
        low, high = np.sort(step[first]), np.sort(step[last]) + 1  # intervals of one length do not overlap
        new = common[high] < 0
        low, high = low[new], high[new]
        common[high] = length
        if not len(low):
            break
    common = common[:n]
    return np.where(common < 0, bound, common)


def repeated_windows(segments: list[np.ndarray], counts: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes of each segment: does it occur twice,
    a segment standing for ``counts`` occurrences of its bytes?"""
    sizes = np.array([len(s) for s in segments])
    # 2..257: bytes, 1: the end of a segment, 0: the end of all
    text = np.ones(int(sizes.sum()) + len(sizes) + 1, np.int64)
    text[-1] = 0
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = inside[-1] = False
    text[inside] = np.concatenate(segments).astype(np.int64) + 2
    order = suffix_order(text, length + 1)
    group = np.cumsum(bounded_prefixes(text, order, length) < length) - 1
    of = np.repeat(np.arange(len(sizes) + 1), np.append(sizes + 1, 1))
    total = np.bincount(group, np.append(counts, 0)[of[order]])
    often = np.empty(len(text), bool)
    often[order] = total[group] > 1
    at = np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(starts, sizes)])
    return often[at]


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return data, BYTE_CODE[data], offsets


def byte_kind(length: int) -> Kind:
    return Kind(length, max(length * 8 // 25, 1), "u1", 1 << 19, byte_symbols, repeated_windows)


def drop_repeated_bytes(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``."""
    names = ("kept", "n_bytes", "n_removed", "n_spans")
    docs = plain(docs)
    spans = repeated_spans(docs, byte_kind(length), doc_id, text).withColumnsRenamed({"x": "__x", "y": "__y", "spans": "__spans"})
    key = row_key(doc_id, text)
    joined = docs.drop(*names).withColumns({"__x": key["x"], "__y": key["y"]}).join(spans, ["__x", "__y"], "left").drop("__x", "__y")
    rest = [c for c in joined.columns if c not in (text, "__spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(text))
            out = []
            for i, s in enumerate(b.column("__spans")):
                own = data[offsets[i] : offsets[i + 1]]
                if not s.is_valid:
                    out.append((own.tobytes(), len(own), 0, 0))
                    continue
                v = s.values
                covered, runs = cover(v.field("start").to_numpy(), v.field("end").to_numpy(), len(own))
                out.append((own[~covered].tobytes(), len(own), int(covered.sum()), runs))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made], [*rest, *names])

    schema = plus(joined.select(*rest).schema, kept="binary", n_bytes="long", n_removed="long", n_spans="long")
    return joined.mapInArrow(run, schema)
