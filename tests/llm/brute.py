"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np

SF = "/root/testdata/sf0.001"


def repeated(sequences: list, length: int) -> list[np.ndarray]:
    """Flags of the symbols covered by a string of ``length`` that starts twice."""
    key = lambda s, i: bytes(s[i : i + length]) if isinstance(s, bytes) else tuple(s[i : i + length])
    starts = Counter(key(s, i) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        flags = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if starts[key(s, i)] > 1:
                flags[i : i + length] = True
        out.append(flags)
    return out


def common_lines(texts: list, least: int) -> list[tuple[str, int, int]]:
    """(text, lines, dropped) for each text; every text is a document."""
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for own in lines for k in {key(x) for x in own} if k)
    out = []
    for own in lines:
        kept = [x for x in own if seen[key(x)] < least]
        out.append(("\n".join(kept), len(own), len(own) - len(kept)))
    return out


def components(codes: list[int], bits: int) -> list[int]:
    """The smallest position that each position reaches."""
    root = list(range(len(codes)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def words_of(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")


def tiling(item: list[str], doc: list[str], least: int) -> int:
    """Words of the item that greedy string tiling covers."""
    a, b, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not (a[i + k] or b[j + k]):
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if not any(a[i : i + best]) and not any(b[j : j + best]):
                a[i : i + best] = [True] * best
                b[j : j + best] = [True] * best
                total += best


def leaks(texts: list, items: list[tuple], least: int = 5, share: float = 0.8) -> list[list]:
    """The ids of the items that each text holds."""
    items = [(k, [w for w in words_of(t) if w]) for k, t in items]
    grams = lambda w: {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
    seeds, out = [grams(w) for _, w in items], []
    for t in texts:
        doc = [w for w in words_of(t) if w]
        own = grams(doc)
        out.append(sorted(k for (k, w), s in zip(items, seeds) if s & own and tiling(w, doc, least) >= share * len(w)))
    return out


def check_packing(rows: list, texts: dict, encode, capacity: int, end: int) -> int:
    """Asserts that pieces are whole and gapless; returns the number of sequences."""
    by, sequences, sizes = defaultdict(list), defaultdict(list), set()
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        sizes.add(r["length"])
    for k, text in texts.items():
        ids, at = np.array([*encode(text or ""), end], "<u4"), 0
        own = sorted(by[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        for i, r in enumerate(own):
            assert r["start"] == at and (r["length"] == capacity or i == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)
