"""Substring dedup: words of long repeated passages go.

A word goes if a window of ``length`` words that covers it also starts
anywhere else, in the same document or another, judged on the input. The
reference is the corpus itself, cut into shards: segments that may hold such
windows are dealt to shards by the hash of a run of words (``_repeats``), each
shard of bounded size builds one suffix automaton of its segments, and the
segments that need it stream through it for matching statistics: at each word
the length of the longest suffix read so far that the reference holds twice.
A length of ``length`` or more ends a repeated window, and such windows make
up the maximal spans. (An automaton is sent to the shard's own segments and
not to every task, as shards of a whole corpus have no size bound together.)

Defined cases: a null text has no words; texts of fewer words than ``length``
keep all; repeated rows are documents of their own, so they lose what they
share; matches never cross documents; nulls and other columns are carried; an
empty table gives an empty table. Kept words are joined by one space. Result
columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._repeats import Kind, cover, repeated_spans
from ._store import plain, plus, row_key
from ._text import word_bounds, word_codes


class Automaton:
    """The suffix automaton of several sequences, with the number of times that
    each state's strings occur (a sequence counts ``weight`` times)."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.times = [-1], [0], [0]

    def add(self, words: list[int], weight: int) -> None:
        nexts, link, size, times = self.next, self.link, self.size, self.times
        last = 0
        for w in words:
            q = nexts[last].get(w)
            if q is not None and size[q] == size[last] + 1:  # read before, from the start of a sequence
                last = q
                times[last] += weight
                continue
            if q is None:
                now, p = len(size), last
                nexts.append({})
                link.append(0)
                size.append(size[last] + 1)
                times.append(0)
                while p >= 0 and w not in nexts[p]:
                    nexts[p][w] = now
                    p = link[p]
                if p >= 0:
                    link[now] = self.split(p, w)
                last = now
            else:
                last = self.split(last, w)
            times[last] += weight

    def split(self, p: int, w: int) -> int:
        """The state of p's longest string and w, parted from longer ones if need be."""
        nexts, link, size = self.next, self.link, self.size
        q = nexts[p][w]
        if size[q] == size[p] + 1:
            return q
        clone = len(size)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        self.times.append(0)
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def count(self) -> list[int]:
        """Adds up occurrences over suffix links; returns, for each state, the
        length of its longest suffix that occurs twice."""
        by_size = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for s in reversed(by_size):
            if self.link[s] > 0:
                self.times[self.link[s]] += self.times[s]
        twice = [0] * len(self.size)
        for s in by_size:
            twice[s] = self.size[s] if self.times[s] > 1 else twice[self.link[s]]
        return twice


def repeated_windows(segments: list[np.ndarray], counts: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words of each segment: does it occur twice,
    a segment standing for ``counts`` occurrences of its words?"""
    automaton = Automaton()
    lists = [s.tolist() for s in segments]
    for words, n in zip(lists, counts.tolist()):
        automaton.add(words, n)
    twice, nexts, out = automaton.count(), automaton.next, []
    for words in lists:
        state = 0
        for i, w in enumerate(words, 1):
            state = nexts[state][w]  # the segment is in the reference, so every step is there
            if i >= length:
                out.append(min(twice[state], i) >= length)
    return np.array(out, bool)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = word_bounds(data, offsets)
    codes = word_codes(data, starts, ends)
    return codes, codes, np.searchsorted(doc, np.arange(len(offsets)))


def word_kind(length: int) -> Kind:
    return Kind(length, max(length * 2 // 7, 1), "u8", 1 << 17, word_symbols, repeated_windows)


def drop_repeated_passages(docs: DataFrame, length: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the kept words as text, plus ``n_words`` and ``n_removed``."""
    names = ("n_words", "n_removed")
    docs = plain(docs)
    spans = repeated_spans(docs, word_kind(length), doc_id, text).withColumnsRenamed({"x": "__x", "y": "__y", "spans": "__spans"})
    key = row_key(doc_id, text)
    joined = docs.drop(*names).withColumns({"__x": key["x"], "__y": key["y"]}).join(spans, ["__x", "__y"], "left").drop("__x", "__y")
    columns = [c for c in joined.columns if c != "__spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column(text).to_pylist(), b.column("__spans")):
                words = (t or "").encode().split()  # bytes: ASCII white space
                n, gone = len(words), 0
                if s.is_valid:
                    covered, _ = cover(s.values.field("start").to_numpy(), s.values.field("end").to_numpy(), n)
                    words, gone = [words[i] for i in np.flatnonzero(~covered).tolist()], int(covered.sum())
                out.append((b" ".join(words).decode(), n, gone))
            made = dict(zip((text, *names), (pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.int64(), pa.int64())))))
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in (*columns, *names)], [*columns, *names])

    return joined.mapInArrow(run, plus(joined.select(*columns).schema, n_words="long", n_removed="long"))
