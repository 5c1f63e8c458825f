"""Token ids of texts, unit by unit, in arrays.

A unit is a stretch of text that a tokenizer never joins with what stands before or
after it. All units of a slice of texts are cut and sorted at once; only those
that the worker does not know yet go to the tokenizer, and each text's ids are gathered from
the table. A unit is known by 64 bits. A text with white space other than single
characters between two others is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ._text import slices, utf8, word_codes

RUNS = re.compile(r"^\s|\s\s|\s$")  # white space that is not between two other characters
SLICE = 1 << 20  # bytes of text
KNOWN = 600_000  # units that a table keeps

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
POINT = np.zeros(256, bool)
POINT[[*b".,;:!?"]] = True


WHITE = np.zeros(256, bool)  # one-byte white space, also where only some libraries call it that
WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
WIDE = np.zeros(256, bool)  # first bytes of longer white space (and of much else)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def plain_texts(texts: list[str], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have white space only as single characters between two others."""
    white, rough = WHITE[data], np.zeros(len(texts), bool)
    size = np.diff(offsets)
    rough[size == 0] = True
    there = np.flatnonzero(~rough)
    rough[there] = white[offsets[there]] | white[offsets[there + 1] - 1]
    of = lambda at: np.searchsorted(offsets, at, "right") - 1
    pairs = np.flatnonzero(white[1:] & white[:-1])
    rough[of(pairs)] = True  # one too many where the second begins a text: that text is rough by itself, this one ends so
    maybe = np.zeros(len(texts), bool)
    maybe[of(np.flatnonzero(WIDE[data]))] = True
    for k in np.flatnonzero(maybe & ~rough).tolist():
        rough[k] = RUNS.search(texts[k]) is not None
    return ~rough


def words(data: np.ndarray) -> np.ndarray:
    """Where units may begin: at blanks and at both sides of an end of line."""
    begin = (data == 0x20) | (data == 0x0A)
    begin[1:] |= data[:-1] == 0x0A
    return begin


def words_and_points(data: np.ndarray) -> np.ndarray:
    """As ``words``, and at a mark behind a letter, where byte-level tokenizers part words."""
    begin = words(data)
    begin[1:] |= POINT[data[1:]] & LETTER[data[:-1]]
    return begin


class Units:
    """Ids (of ``kind``) of the units that a worker has met. ``learn`` gives the ids of new ones (bytes)."""

    def __init__(self, begins: Callable[[np.ndarray], np.ndarray], learn: Callable[[list[bytes]], list[list[int]]], kind: type = np.uint16):
        self.begins, self.learn, self.kind = begins, learn, kind
        self.codes, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin), texts one after the other in ``data``; none is empty."""
        begin = self.begins(data)
        begin[offsets[:-1]] = True
        starts = np.flatnonzero(begin)
        bounds = np.append(starts, len(data))
        # a long text's units are looked up run by run
        found = [self.look_up(data, bounds[i:j], bounds[i + 1 : j + 1]) for i, j in slices(bounds, 2 * SLICE)]
        ids, size = (np.concatenate(x) for x in zip(*found))
        return ids, np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, offsets)]

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of units one after the other, how many each has)."""
        unlike, first, at = np.unique(word_codes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.codes, unlike), max(len(self.codes) - 1, 0))
        new = np.flatnonzero(self.codes[place] != unlike) if len(self.codes) else np.arange(len(unlike))
        if len(new):
            raw, zero = data[starts[0] : ends[-1]].tobytes(), starts[0]
            made = self.learn([raw[x:y] for x, y in zip((starts[first[new]] - zero).tolist(), (ends[first[new]] - zero).tolist())])
            size = np.fromiter(map(len, made), np.int64, len(made))
            known = np.ones(len(self.codes), bool)
            if len(self.codes) + len(new) > KNOWN:  # those of this slice stay
                known[:] = False
                known[np.delete(place, new)] = True
            self.keep(known, unlike[new], size, np.fromiter((i for ids in made for i in ids), self.kind, int(size.sum())))
            place = np.searchsorted(self.codes, unlike)
        own = place[at]
        size = self.size[own]
        total = np.cumsum(size)
        return self.ids[np.arange(total[-1]) + np.repeat(self.at[own] - (total - size), size)], size

    def keep(self, known: np.ndarray, codes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        if not known.all():
            at, n = self.at[known], self.size[known]
            total = np.cumsum(n)
            self.ids = self.ids[np.arange(total[-1] if len(n) else 0) + np.repeat(at - (total - n), n)]
            self.codes, self.size, self.at = self.codes[known], n, total - n
        codes = np.concatenate((self.codes, codes))
        order = np.argsort(codes, kind="stable")
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(size) - size))[order]
        self.codes, self.size = codes[order], np.concatenate((self.size, size))[order]
        self.ids = np.concatenate((self.ids, ids))


def in_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE`` bytes of text, so that a worker holds few texts as Python strings."""
    for b in batches:
        for i, j in slices(utf8(b.column(column))[1], SLICE):
            yield b.slice(i, j - i)


def encoded(texts: list[str], before: bytes, parts: list[tuple[Units, Callable[[str], list[int]]]]) -> Iterator[list[np.ndarray]]:
    """For each text, its ids (of the units' kind) by each of ``parts``: a table of units, and what
    encodes a whole text. Units see ``before`` in front of a text; an empty text has no ids."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    for i, j in slices(offsets, SLICE):
        fine = plain_texts(texts[i:j], np.frombuffer(b"".join(raw[i:j]), np.uint8), offsets[i : j + 1] - offsets[i])
        plain = (i + np.flatnonzero(fine)).tolist()
        out: dict[int, list[np.ndarray]] = {k: [] for k in range(i, j)}
        if plain:
            data = np.frombuffer(b"".join([x for k in plain for x in (before, raw[k])]), np.uint8)
            at = np.concatenate(([0], np.cumsum([len(before) + len(raw[k]) for k in plain])))
            for units, _ in parts:
                ids, begin = units(data, at)
                for k, x, y in zip(plain, begin.tolist(), begin[1:].tolist()):
                    out[k].append(ids[x:y])
        for k in range(i, j):
            if not out[k]:
                out[k] = [np.array(whole(texts[k]) if texts[k] else [], units.kind) for units, whole in parts]
            yield out[k]


# ------------------------------------------------------------------ byte-level tokenizers
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    itself if it has a mark of its own, else the next unused one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level(tokenizer, kind: type = np.uint16) -> Units:
    """Units of a byte-level tokenizer (of the tokenizers library)."""
    letters = byte_letters()
    blank, tokenize, encode = letters[0x20], tokenizer.model.tokenize, tokenizer.encode

    def learn(units: list[bytes]) -> list[list[int]]:
        out = []
        for u in units:
            text = u.decode()
            word = text[1:] if text[0] == " " else text
            if word.isalpha() and word.isascii():  # one piece, so its merges can be asked for directly
                out.append([t.id for t in tokenize(text.replace(" ", blank))])
            elif word.isalpha() and max(word) < "ɐ":  # letters of blocks that every version of Unicode agrees on
                out.append([t.id for t in tokenize(u.decode("latin-1").translate(letters))])
            else:
                out.append(encode(text, add_special_tokens=False).ids)
        return out

    return Units(words_and_points, learn, kind)
