"""Token files: ids by frequency rank in byte-aligned variable-length coding.

A corpus is tokenized once; ids are counted over all documents (a task returns
one row for each id it met) and the commonest gets rank 0, so most tokens
take one byte. Documents are dealt by ranges of their ids to tasks, each of which
writes one file of blocks in ascending order.

A block is its header, an index (an Arrow stream of ``doc_id`` and
``n_tokens``), the control bytes and the data bytes. A control byte holds four
lengths less one, two bits each, the first lowest; data bytes hold the ranks,
little-endian, in as many bytes. A reader takes, by table, each control byte's
total to find where its four ranks begin, and their bytes' places relative to that,
so a block is decoded without a loop over tokens. The folder holds the files,
``ids`` (ids by rank, little-endian unsigned 32-bit) and ``blocks`` (Parquet: one
row a block, with the tokens of all blocks before it).

Order: ascending ``doc_id`` (null first); rows of one id by number of tokens, then
by the checksum of their ids, then as the table has them. Equal rows are ranged by
a number of their own, so an id that a third of the rows hold is split too.

Defined cases: a null or empty text is the end id alone; repeated rows are written
each; an empty table has no blocks. Only the id and the text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _files
from ._store import spread, stage
from ._units import byte_level, encoded

BLOCK = 1 << 20  # tokens of a block, or those of one longer document
HEADER = "<4sQQQQ"  # mark, bytes of the index, tokens, control bytes, data bytes
MARK = b"RNK1"
CHUNK = 1 << 17  # control bytes decoded at once

# ------------------------------------------------------------------ coding
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1  # of the four ranks of a control byte
TOTALS = LENGTHS.sum(1)
FIRST = np.cumsum(LENGTHS, 1) - LENGTHS
THERE = (np.arange(4) < LENGTHS[:, :, None]).reshape(256, 16)  # which bytes of four 32-bit numbers are stored
PLACES = (FIRST[:, :, None] + np.arange(4)).reshape(256, 16) * THERE  # and where, from the first


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    less = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    four.reshape(-1)[: len(ranks)] = less
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= less[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again, by table lookup. The last control byte's unused lengths are one byte each, not stored."""
    control = np.frombuffer(control, np.uint8)
    data = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(16, np.uint8)))
    out, at = np.empty((len(control), 16), np.uint8), 0
    for i in range(0, len(control), CHUNK):
        c = control[i : i + CHUNK]
        totals = TOTALS[c]
        starts = at + np.cumsum(totals) - totals
        out[i : i + CHUNK] = data[starts[:, None] + PLACES[c]] * THERE[c]
        at += int(totals.sum())
    return out.view("<u4").reshape(-1)[:count]


# ------------------------------------------------------------------ tasks
_tables: dict[str, tuple] = {}


def table(path: str) -> tuple:
    """(units, what encodes a whole text) of a tokenizer file; one for each worker."""
    if path not in _tables:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _tables[path] = byte_level(tokenizer), (lambda s: tokenizer.encode(s, add_special_tokens=False).ids), special
    return _tables[path]


def tokenized(docs: DataFrame, tokenizer: str, end: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, row, n_tokens, ids_crc32, ids (two bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, whole, special = table(tokenizer)
        last = np.array([end], "<u2")
        for b in batches:
            texts = b.column(1).fill_null("").to_pylist()
            # a special token's string is that token, wherever it stands
            marked = [k for k, t in enumerate(texts) if any(s in t for s in special)]
            found = [own[0] for own in encoded([t if k not in marked else "" for k, t in enumerate(texts)] if marked else texts, b"", [(units, whole)])]
            for k in marked:
                found[k] = np.array(whole(texts[k]), np.uint16)
            ids = [np.concatenate((x, last)) for x in found]
            sums, sizes = [zlib.crc32(x.astype("<u4")) for x in ids], [len(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "row", "n_tokens", "ids_crc32", "ids"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(doc_id, text, F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, ids_crc32 long, ids binary")


def as_ids(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or at[0] == at[-1]:
        return np.zeros(0, np.uint16)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u2")


def id_counts(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """id, n over all documents: at most ``vocabulary`` rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(vocabulary, np.int64)
        for b in batches:
            sums += np.bincount(as_ids(b.column(0)), minlength=vocabulary)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(sums[met])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_blocks(tokens: DataFrame, path: str, by_rank: np.ndarray, vocabulary: int, block: int) -> DataFrame:
    """part, block, file, at, size, n_tokens: what was written, in the order of ``tokens`` within each partition."""
    ranks = np.zeros(vocabulary, "<u4")
    ranks[by_rank] = np.arange(len(by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, number, held, many = None, 0, 0, [], 0

        def put() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_table(rows.combine_chunks())
            index = sink.getvalue().to_pybytes()
            control, data = encode_ranks(np.concatenate(numbers))
            start = out.at
            for piece in (struct.pack(HEADER, MARK, len(index), many, len(control), len(data)), index, control, data):
                out.add(piece)
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "file": out.name, "at": start, "size": out.at - start, "n_tokens": many}], BLOCKS)

        numbers = []
        for b in batches:
            if out is None and b.num_rows:
                part, out = b.column("part")[0].as_py(), _files.Writer(path, _files.new_name("part"))
            ends = np.cumsum(b.column("n_tokens").to_numpy())
            i = 0
            while i < b.num_rows:
                done = ends[i - 1] if i else 0
                j = int(np.searchsorted(ends, done + block - many, "right"))  # documents that still fit
                if j == i and not many:
                    j = i + 1  # one longer than a block
                if j > i:
                    rows = b.slice(i, j - i)
                    numbers.append(ranks[as_ids(rows.column("ids"))])
                    held.append(rows.select(["doc_id", "n_tokens"]))
                    many += int(ends[j - 1] - done)
                if j < b.num_rows or many >= block:
                    yield put()
                    number, held, numbers, many = number + 1, [], [], 0
                i = j
        if held:
            yield put()
        if out is not None:
            out.close()

    BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])
    named = tokens.select("doc_id", "n_tokens", "ids", F.spark_partition_id().alias("part"))
    return named.mapInArrow(run, "part int, block long, file string, at long, size long, n_tokens long")


# ------------------------------------------------------------------ operators
def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end: int, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> None:
    """Writes all documents' ids, each document's end included, to the folder ``path``.
    ``vocabulary``: ids, the end included, are below it."""
    if vocabulary > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    spark, held = docs.sparkSession, _files.folder(docs.sparkSession, "tokens")
    found = tokenized(docs, tokenizer, end, doc_id, text)
    found.write.option("compression", "zstd").parquet(held)
    tokens = spark.read.schema(found.schema).parquet(held)
    counts = id_counts(tokens, vocabulary).toPandas()  # at most ``vocabulary`` rows
    by_rank = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy().astype("<u4")
    _files.write(path, "ids", by_rank.tobytes())
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32", "row"]
    ranged = tokens.repartitionByRange(spread(tokens), *order).sortWithinPartitions(*order)
    blocks = stage(write_blocks(ranged, path, by_rank, vocabulary, block), "blocks")
    # tokens before a block: within its file, and in the files before (one row a file)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("part").agg(F.sum("n_tokens").alias("own")).withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0)))
    blocks = blocks.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files.drop("own"), "part")
    blocks = blocks.select("part", "block", "file", "at", "size", "n_tokens", (F.col("base") + F.col("within")).alias("start"))
    blocks.write.parquet(f"{path}/blocks")


@lru_cache(4)
def ids_by_rank(path: str) -> np.ndarray:
    return np.frombuffer(_files.read(path, "ids"), "<u4")


def read_block(raw: bytes) -> tuple[pa.Table, np.ndarray]:
    """(doc_id and n_tokens, ranks) of one block."""
    mark, index, count, controls, size = struct.unpack_from(HEADER, raw)
    a = struct.calcsize(HEADER)
    if mark != MARK or len(raw) != a + index + controls + size:
        raise ValueError("not a whole block of token ranks")
    b, c = a + index, a + index + controls
    return pa.ipc.open_stream(raw[a:b]).read_all(), decode_ranks(raw[b:c], raw[c:], count)


def read_tokens(spark: SparkSession, path: str, doc_id: str = "long", ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian
    unsigned 32-bit) of every document in the folder; ``doc_id`` is the id's type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                index, ranks = read_block(_files.read(path, r["file"], r["at"], r["size"]))
                raw = memoryview(ids_by_rank(path)[ranks].tobytes())
                sizes = index.column("n_tokens").to_numpy()
                ends = np.cumsum(sizes)
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [index.column("doc_id").combine_chunks(), pa.array(r["start"] + ends - sizes), pa.array(sizes)]
                columns += [pa.array([zlib.crc32(x) for x in own], pa.int64()), *([pa.array(own, pa.binary())] if ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "file", "at", "size", "start")
    blocks = blocks.repartition(spread(blocks), "part", "block")
    return blocks.mapInArrow(run, f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))
