"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes.

Both tokenizers read a text with a space before it, so offsets where tokens of
both end cut it into groups. Tokens overlap in one stretch between neighbouring
ends of either tokenizer, so a text's links are as many as its ends, and all are found
by merging the two lists of ends.

Tokenizing writes each text's ids once; the passes that follow align again from
ids and the tables of token lengths. The first gathers the distinct pairs. Each
shard of them gets a minimal perfect hash (levels of bits: a key takes its bit where
no other of its level falls on it, the rest go on; its number is the bits
set before its own). The second counts: a task makes a dense vector of counts
by that number for each shard, and vectors are summed in two levels. A shard's file
then holds the hash, the keys by number, which every lookup is verified
against, and the counts. The last pass aligns once more and looks up the counts.

Memory: a task holds at most ``HELD`` distinct keys before it hands them on, one
shard's vector, and at most ``CACHED`` bytes of shard files; pairs beyond that are read
again from the shared folder. The driver holds the list of shard files and the highest
count of each id of the second tokenizer.

Defined cases: a null or empty text, and one whose tokens do not spell it, has no
tokens, zeros and ''. Repeated rows count again; nulls in the id are carried; an empty
table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _files
from ._store import spread, stage
from ._text import mix, utf8
from ._units import Units, byte_letters, byte_level, encoded, in_slices, words

BLANK = "▁"
SHARD = 1 << 15  # keys of a shard, about
HELD = 1 << 21  # distinct keys in a task
CACHED = 48 << 20  # bytes of shard files in a worker
AT_ONCE = 1 << 19  # ids aligned at once, or those of one longer document
FAN = 16  # vectors summed in the first level: those of one in so many tasks
DOC = "doc_id {kind}, a binary, b binary"


# ------------------------------------------------------------------ tokenizers
def pieces_of(model) -> Units | None:
    """Units of a sentencepiece model that sees a blank before each text; None if its pieces
    may go on after a blank or hold an end of line, so that texts have no such units."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in names):
        return None

    def learn(units: list[bytes]) -> list[list[int]]:
        # a unit after a blank as the model's own texts; others behind an end of line, whose ids are then left out
        made = model.encode([u[1:].decode() if u[:1] == b" " else "\n" + u.decode() for u in units], num_threads=1)
        line = len(model.encode("\n"))
        return [ids if u[:1] == b" " else ids[line:] for u, ids in zip(units, made)]

    return Units(words, learn)


class Encoders:
    """Both tokenizers of a worker."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        first, second = Tokenizer.from_file(byte_file), sentencepiece.SentencePieceProcessor(model_file=piece_file)
        first.encode_special_tokens = True  # their strings are plain text
        self.whole = (lambda t: first.encode(" " + t, add_special_tokens=False).ids), (lambda t: second.encode(t))
        self.units = byte_level(first), pieces_of(second)

    def texts(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        if self.units[1] is None:
            return ([np.array(f(t) if t else [], np.uint16) for f in self.whole] for t in texts)
        return encoded(texts, b" ", list(zip(self.units, self.whole)))


def spellings(byte_level: str, pieces: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of all tokens of either tokenizer, one after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    back = {c: b for b, c in byte_letters().items()}
    names = sorted(Tokenizer.from_file(byte_level).get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
    first: list[bytes] = [b""] * (names[-1][1] + 1)
    for name, i in names:
        first[i] = bytes(back[c] for c in name if c in back)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    second = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
    return joined(first), joined(second)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def spelled(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens one after the other, and where each ends."""
    raw, at = table
    lens = (at[1:] - at[:-1])[ids]
    ends = np.cumsum(lens)
    return raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[ids] - (ends - lens), lens)], ends


_encoders: dict[tuple, tuple] = {}


def tools(byte_level: str, pieces: str) -> tuple:
    """(encoders, spellings) of two files; one for each worker."""
    key = byte_level, pieces
    if key not in _encoders:
        _encoders[key] = Encoders(*key), spellings(*key)
    return _encoders[key]


def tokenized(docs: DataFrame, byte_level: str, pieces: str, doc_id: str, text: str) -> DataFrame:
    """doc_id, a, b: ids (unsigned 16-bit) by both tokenizers; empty where a text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, (first, second) = tools(byte_level, pieces)
        for b in in_slices(batches, 1):
            texts = b.column(1).fill_null("").to_pylist()
            a_ids, b_ids = [], []
            for t, (a, c) in zip(texts, encoders.texts(texts)):
                want = np.frombuffer(b" " + t.encode(), np.uint8) if t else np.zeros(0, np.uint8)
                same = all(np.array_equal(spelled(x, table)[0], want) for x, table in ((a, first), (c, second)))
                a_ids.append(a.tobytes() if same else b"")
                b_ids.append(c.tobytes() if same else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a_ids, pa.binary()), pa.array(b_ids, pa.binary())], ["doc_id", "a", "b"])

    return docs.select(doc_id, text).mapInArrow(run, DOC.format(kind=docs.schema[doc_id].dataType.simpleString()))


# ------------------------------------------------------------------ alignment
class Aligned:
    """Documents' ids, and their links as positions of tokens of either side."""

    def __init__(self, a: pa.Array, b: pa.Array, lengths: tuple[np.ndarray, np.ndarray]):
        (a, a_at), (b, b_at) = utf8_ids(a), utf8_ids(b)
        self.a, self.b, self.a_at, self.b_at = a, b, a_at, b_at
        a_ends, b_ends = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
        size = int(a_ends[-1]) if len(a) else 0
        in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        in_a[a_ends], in_b[b_ends] = True, True
        ends = np.flatnonzero(in_a | in_b)
        in_a, in_b = in_a[ends], in_b[ends]
        # a token is on the links after the token before it ends
        self.links = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        self.cuts = np.flatnonzero(in_a & in_b)  # links that end a group
        # a document ends where a group ends
        last = np.concatenate(([0], a_ends))[a_at]
        self.at = np.searchsorted(ends, last, "right") if len(ends) else np.zeros(len(a_at), np.int64)
        self.at[0] = 0

    def keys(self) -> np.ndarray:
        return self.a[self.links[0]].astype(np.int64) << 32 | self.b[self.links[1]]

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups as text (a1,a2|b1;...) of all documents, and where each document's begins; every
        document but the last is followed by one more mark."""
        a_group = np.searchsorted(self.links[0][self.cuts], np.arange(len(self.a)))
        b_group = np.searchsorted(self.links[1][self.cuts], np.arange(len(self.b)))
        n = len(self.a) + len(self.b)
        ids, marks = np.empty(n, np.int64), np.empty(n, np.uint8)
        groups = np.arange(len(self.cuts) + 1)
        at_a = np.arange(len(self.a)) + np.searchsorted(b_group, groups)[a_group]  # after the other side's tokens of groups before
        at_b = np.arange(len(self.b)) + np.searchsorted(a_group, groups, "right")[b_group]  # and of its own group
        for at, own, group, mark in ((at_a, self.a, a_group, b"|"), (at_b, self.b, b_group, b";")):
            ids[at] = own
            more = np.append(group[1:] == group[:-1], False) if len(group) else np.zeros(0, bool)
            marks[at] = np.where(more, ord(","), mark[0])
        text, width = digits(ids, marks)
        begin = np.concatenate(([0], np.cumsum(width)))
        return text, begin[self.a_at + self.b_at]


def utf8_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = utf8(column)
    return np.frombuffer(raw.tobytes(), "<u2").astype(np.int64), at // 2


PLACES = 10 ** np.arange(4, -1, -1)
DIGITS = (np.arange(1 << 16)[:, None] // PLACES % 10 + ord("0")).astype(np.uint8)
WRITTEN = (np.arange(1 << 16)[:, None] >= PLACES) | (PLACES == 1)  # no leading zeros


def digits(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimals of 16-bit numbers, each followed by its mark, and their widths."""
    text = np.concatenate((DIGITS[ids], marks[:, None]), 1)
    there = np.concatenate((WRITTEN[ids], np.ones((len(ids), 1), bool)), 1)
    return text[there], there.sum(1)


def parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of ids."""
    at = utf8(batch.column("a"))[1] + utf8(batch.column("b"))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


# ------------------------------------------------------------------ minimal perfect hash
class Hash:
    """Numbers 0 .. n - 1 for n distinct 64-bit keys; any other key gets one of them, or -1."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words  # 64 bits each, by level
        every = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(every), dtype=np.int64)))
        self.firsts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)

    @staticmethod
    def spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys.view(np.uint64) + mix(np.array([level + 1], np.uint64))) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> "Hash":
        left, words = keys, []
        while len(left):
            bits = -(-2 * len(left) // 64) * 64
            at = cls.spot(left, len(words), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(words)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, words in enumerate(self.words):
            at = self.spot(keys[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[self.firsts[level] + (at >> 6)] + below)[hit]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        sizes = [len(w) for w in self.words]
        return struct.pack(f"<I{len(sizes)}I", len(sizes), *sizes) + b"".join(w.astype("<u8").tobytes() for w in self.words)

    @classmethod
    def unpack(cls, raw: bytes) -> "Hash":
        (n,) = struct.unpack_from("<I", raw)
        sizes = struct.unpack_from(f"<{n}I", raw, 4)
        words = np.frombuffer(raw, "<u8", sum(sizes), 4 + 4 * n)
        return cls(np.split(words, np.cumsum(sizes)[:-1]) if n else [])


class Shard:
    """A shard's hash, its keys by number and their counts (none before they are counted)."""

    def __init__(self, raw: bytes):
        a, b = struct.unpack_from("<QQ", raw)
        self.hash = Hash.unpack(raw[16 : 16 + a])
        self.keys, self.counts = np.frombuffer(raw[16 + a : 16 + a + b], "<i8"), np.frombuffer(raw[16 + a + b :], "<i8")
        self.size = 2 * len(raw)

    @staticmethod
    def pack(hash_: bytes, keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
        keys, counts = keys.astype("<i8").tobytes(), b"" if counts is None else counts.astype("<i8").tobytes()
        return struct.pack("<QQ", len(hash_), len(keys)) + hash_ + keys + counts

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = self.hash(keys)
        if (out < 0).any() or not np.array_equal(self.keys[out], keys):
            raise ValueError("a pair that the first pass did not meet")
        return out


class Shards:
    """The shards of a folder, by number; of those read, at most ``CACHED`` bytes are held."""

    def __init__(self, path: str, names: dict[int, str], count: int):
        self.path, self.names, self.count, self.held, self.size = path, names, count, OrderedDict(), 0

    def __getitem__(self, number: int) -> Shard:
        if number not in self.held:
            shard = self.held[number] = Shard(_files.read(self.path, self.names[number]))
            self.size += shard.size
            while self.size > CACHED and len(self.held) > 1:
                self.size -= self.held.popitem(last=False)[1].size
        self.held.move_to_end(number)
        return self.held[number]

    def split(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions of its keys)."""
        own = shard_of(keys, self.count)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1]))) if len(keys) else np.zeros(0, np.int64)
        for x, at in zip(own[order][first], np.split(order, first[1:])):
            yield int(x), at


def shard_of(keys: np.ndarray, count: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(count)).astype(np.int64)


# ------------------------------------------------------------------ passes
Lengths = tuple[np.ndarray, np.ndarray]


def distinct(tokens: DataFrame, lengths: Lengths) -> DataFrame:
    """key: the distinct pairs of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray = np.zeros(0, np.int64)
        for b in batches:
            for own in parts(b, AT_ONCE):
                held = np.union1d(held, Aligned(own.column("a"), own.column("b"), lengths).keys())
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])
                    held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])

    return tokens.select("a", "b").mapInArrow(run, "key long").distinct()


def grouped(batches: Iterator[pa.RecordBatch], use: Callable) -> Iterator:
    """Runs of rows with the same first column, given as lists of batches to ``use``."""
    held, own = [], None
    for b in batches:
        shard = b.column(0).to_numpy()
        for i, j in zip(first := np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else [], [*first[1:], len(shard)]):
            if held and shard[i] != own:
                yield use(own, held)
                held = []
            own = int(shard[i])
            held.append(b.slice(i, j - i))
    if held:
        yield use(own, held)


FILE = pa.schema([("shard", pa.int64()), ("file", pa.string())])


def build_hashes(keys: DataFrame, path: str, count: int) -> DataFrame:
    """shard, file: a minimal perfect hash and the keys by number, for each shard."""

    def build(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = np.concatenate([b.column(1).to_numpy() for b in held])
        made, by_number, name = Hash.of(own), np.empty(len(own), np.int64), _files.new_name("pairs")
        by_number[made(own)] = own
        _files.write(path, name, Shard.pack(made.pack(), by_number))
        return pa.RecordBatch.from_pylist([{"shard": shard, "file": name}], FILE)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column(0).to_numpy(), count)), b.column(0)], ["shard", "key"])

    dealt = keys.mapInArrow(number, "shard long, key long").repartition(min(count, spread(keys)), "shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(lambda batches: grouped(batches, build), "shard long, file string")


def count_vectors(tokens: DataFrame, lengths: Lengths, shards: Shards) -> DataFrame:
    """shard, task, counts: dense vectors of 64-bit counts by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, task = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def vectors() -> Iterator[pa.RecordBatch]:
            for s, at in shards.split(keys):
                shard = shards[s]
                vector = np.zeros(len(shard.keys), "<i8")
                vector[shard.numbers(keys[at])] = counts[at]
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([task], pa.int32()), pa.array([vector.tobytes()], pa.binary())], ["shard", "task", "counts"])

        for b in batches:
            task = b.column("task")[0].as_py() if b.num_rows else task
            for own in parts(b, AT_ONCE):
                more, n = np.unique(Aligned(own.column("a"), own.column("b"), lengths).keys(), return_counts=True)
                keys, at = np.unique(np.concatenate((keys, more)), return_inverse=True)
                counts, old = np.zeros(len(keys), np.int64), counts
                counts[at[: len(old)]] = old
                counts[at[len(old) :]] += n
                if len(keys) > HELD:
                    yield from vectors()
                    keys, counts = keys[:0], counts[:0]
        yield from vectors()

    return tokens.select("a", "b", (F.spark_partition_id() % FAN).alias("task")).mapInArrow(run, "shard long, task int, counts binary")


def add_up(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Vectors of the same shard (and task) added, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["shard", "task", "counts"])
        for b in batches:
            for shard, task, counts in zip(*(b.column(i) for i in range(3))):
                key, vector = (shard.as_py(), task.as_py() if "task" in by else 0), np.frombuffer(counts.as_buffer(), "<i8")
                if key == own:
                    total = total + vector
                else:
                    if own is not None:
                        yield row()
                    own, total = key, vector
        if own is not None:
            yield row()

    return vectors.repartition(spread(vectors), *by).sortWithinPartitions(*by).mapInArrow(run, "shard long, task int, counts binary")


def finish(totals: DataFrame, path: str, shards: Shards) -> DataFrame:
    """shard, file, bests: each shard's file again with its counts, and the highest count of each second id in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, counts in zip(b.column(0).to_pylist(), b.column(2)):
                shard, counts, name = shards[s], np.frombuffer(counts.as_buffer(), "<i8"), _files.new_name("counts")
                _files.write(path, name, Shard.pack(shard.hash.pack(), shard.keys, counts))
                ids = shard.keys & 0xFFFFFFFF
                order = np.lexsort((counts, ids))
                last = np.flatnonzero(np.append(ids[order][1:] != ids[order][:-1], True))
                bests = [{"id": int(i), "n": int(n)} for i, n in zip(ids[order][last], counts[order][last])]
                yield pa.RecordBatch.from_pylist([{"shard": s, "file": name, "bests": bests}], schema)

    schema = pa.schema([*FILE, ("bests", pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())])))])
    return totals.mapInArrow(run, "shard long, file string, bests array<struct<id:int,n:long>>")


def look_up(tokens: DataFrame, lengths: Lengths, shards: Shards, best: np.ndarray) -> DataFrame:
    """The contract's figures for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in parts(b, AT_ONCE):
                found = Aligned(own.column("a"), own.column("b"), lengths)
                links = found.keys()
                keys, at = np.unique(links, return_inverse=True)
                counts = np.zeros(len(keys), np.int64)
                for s, here in shards.split(keys):
                    shard = shards[s]
                    counts[here] = shard.counts[shard.numbers(keys[here])]
                tops = counts == best[keys & 0xFFFFFFFF]
                added = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[found.at])
                n_links, ended = np.diff(found.at), np.zeros(len(links), np.int64)
                ended[found.cuts] = 1
                text, begin = found.written()
                raw = memoryview(text.tobytes())
                shas = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(begin.tolist(), begin[1:].tolist())]
                columns = [np.diff(found.a_at), np.diff(found.b_at), added(ended), n_links, added(tops[at].astype(np.int64)), added(counts[at])]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(shas, pa.string())], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string")


def pair_counts(tokens: DataFrame, lengths: Lengths) -> tuple[Shards, np.ndarray]:
    """The shards with their counts, and the highest count of each second id."""
    spark, path = tokens.sparkSession, _files.folder(tokens.sparkSession, "pairs")
    keys = stage(distinct(tokens, lengths), "pairs")
    count = max(1, -(-keys.count() // SHARD))
    listed = lambda rows: {r["shard"]: r["file"] for r in rows}
    shards = Shards(path, listed(stage(build_hashes(keys, path, count), "hashes").collect()), count)  # one row a shard
    vectors = add_up(add_up(count_vectors(tokens, lengths, shards), ["shard", "task"]), ["shard"])
    done = stage(finish(vectors, path, shards), "counts")
    best = np.zeros(len(lengths[1]), np.int64)
    for r in done.select(F.explode("bests").alias("x")).groupBy("x.id").agg(F.max("x.n").alias("n")).collect():  # one row an id at most
        best[r["id"]] = r["n"]
    return Shards(path, listed(done.select("shard", "file").collect()), count), best


def align(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    lengths = tuple(np.diff(at) for _, at in spellings(byte_level, pieces))
    if max(map(len, lengths)) > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    tokens = stage(tokenized(docs, byte_level, pieces, doc_id, text), "aligned")
    shards, best = pair_counts(tokens, lengths)
    return look_up(tokens, lengths, shards, best)
