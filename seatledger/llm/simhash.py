"""SimHash near-dedup: pigeonhole blocks, exact Hamming check, components.

A document's fingerprint is the bitwise majority over the XXH64 values of its
word shingles. Two fingerprints within ``max_bits`` differing bits leave at
least ``n_blocks - max_bits`` of ``n_blocks`` blocks untouched, so each
fingerprint is keyed by every choice of that many blocks, fingerprints that
share a key meet, and their distance is checked.

Copies never meet as pairs: only distinct fingerprints are keyed, and a group
answers with a spanning forest of its links, which has the same components. A
key with many fingerprints is cut into tiles, so every pair of them still
meets in some tile while no task holds more than two chunks.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and links like any other; with fewer words than a shingle
the whole sequence is the one shingle. Repeated rows count as rows of one
document. A null id never becomes a component id, unless the component has no
other. An empty table gives an empty table; other columns are carried along
or left out, never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import plain, plus, row_key, stage

SEED = 42
CHUNK = 1024


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text, as an unsigned 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)  # a majority of one
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = shingle - 1
    h = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())]
    ones = np.zeros(64, np.int64)
    codes = np.array(h, "<u8")
    for i in range(0, len(codes), 1 << 16):  # long texts in slices
        part = codes[i : i + (1 << 16)].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int, text: str = "text", out: str = "simhash") -> DataFrame:
    """``docs`` plus the fingerprint as a signed long."""
    docs = docs.drop(out)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t, shingle) for t in b.column(where).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes.view(np.int64))], [*b.schema.names, out])

    return docs.mapInArrow(run, plus(docs.schema, **{out: "long"}))


def block_masks(n_blocks: int, shared: int) -> list[int]:
    """A 64-bit mask for each choice of ``shared`` of the blocks."""
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, shared)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(codes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``codes`` (positions)."""
    left, out = np.arange(len(codes)), []
    while len(left):
        # grow one tree: what the frontier reaches leaves the rest
        tree, left = left[:1], left[1:]
        while len(tree) and len(left):
            at, tree = tree[0], tree[1:]
            found = np.bitwise_count(codes[left] ^ codes[at]) <= max_bits
            out += [(int(at), int(x)) for x in left[found]]
            tree, left = np.concatenate((tree, left[found])), left[~found]
    return out


def links(codes: DataFrame, max_bits: int, n_blocks: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``code``) whose
    components are those of all links within ``max_bits``."""
    masks = [signed(m) for m in block_masks(n_blocks, n_blocks - max_bits)]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("code").bitwiseAND(m).alias("part")) for i, m in enumerate(masks)])
    keyed = codes.select("code", F.explode(keys).alias("k")).select("code", "k.choice", "k.part")
    shared = keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")

    def tiles(mine: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))

    # each code is there once for each choice, which Spark's estimate of ``keyed`` leaves out: never broadcast
    met = (
        keyed.hint("merge").join(shared, ["choice", "part"])
        .withColumn("mine", F.pmod(F.xxhash64("code"), chunks).cast("int"))
        .withColumn("t", F.explode(tiles(F.col("mine"), chunks)))
        .groupBy("choice", "part", "t")
        .agg(F.collect_list("code").alias("codes"))
        .select("codes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lens = np.diff(column.offsets.to_numpy())
            firsts = np.cumsum(lens) - lens
            two = firsts[lens == 2]  # most groups: at once
            close = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= max_bits]
            a, b_ = [flat[close]], [flat[close + 1]]
            for at, n in zip(firsts[lens > 2].tolist(), lens[lens > 2].tolist()):
                part = flat[at : at + n]
                if edges := forest(part, max_bits):
                    e = np.array(edges)
                    a.append(part[e[:, 0]])
                    b_.append(part[e[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b_)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def document_groups(
    docs: DataFrame, shingle: int, max_bits: int, n_blocks: int = 7, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each document: its id, ``row`` (a key of id and text),
    ``simhash`` (signed long), ``root`` (one value for each component) and
    ``component_id`` (the component's smallest id)."""
    keyed = docs.select(F.col(doc_id), F.col(text).alias("text"), row_key(doc_id, text).alias("row"))
    small = stage(with_fingerprint(keyed, shingle).drop("text").distinct(), "simhash")
    codes = small.groupBy(F.col("simhash").alias("code")).agg(F.min(doc_id).alias("least"))
    roots = components(links(codes.select("code"), max_bits, n_blocks))
    rooted = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select(F.col("code").alias("simhash"), "root", "component_id")
    return small.join(found, "simhash")


def drop_near_duplicates(
    docs: DataFrame, shingle: int, max_bits: int, n_blocks: int = 7, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the
    smallest id (ties: one of them, by a hash of its text; repeated rows: one).

    Keys of rows that go are staged and taken out by an anti-join, so Spark sees
    their size and broadcasts them where they are few; only rows that stay and
    are there more than once are shuffled with their texts."""
    docs = plain(docs)
    groups = stage(document_groups(docs, shingle, max_bits, n_blocks, doc_id, text).select(doc_id, "row", "root"), "groups")
    first = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col("row"))).alias("first")
    firsts = groups.groupBy("root").agg(first).select("root", F.col("first.row").alias("stays"))
    gone = groups.join(firsts, "root").where("row != stays").select(F.col("row.x").alias("__x"), F.col("row.y").alias("__y"))
    key = row_key(doc_id, text)
    left = docs.withColumns({"__x": key["x"], "__y": key["y"]}).join(stage(gone, "gone"), ["__x", "__y"], "left_anti")
    again = stage(left.groupBy("__x", "__y").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    if not again.isEmpty():
        once = left.join(again, ["__x", "__y"], "left_semi").dropDuplicates(["__x", "__y"])
        left = left.join(again, ["__x", "__y"], "left_anti").unionByName(once)
    return left.select(*docs.columns)


def hexadecimal(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")
