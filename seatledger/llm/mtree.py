"""Exact top-k inner products by best-first search of M-trees.

Inner products become distances: with m the greatest squared length, a vector
v gets one more component sqrt(m - |v|^2), a query q a zero, and then
d(q, v)^2 = |q|^2 + m - 2 q.v, so the k nearest by this metric are the k
highest products. The vectors are dealt by id into blocks of bounded size, and
each block is an M-tree: pages of routing entries (pivot, covering radius,
distance to the parent's pivot) over pages of vectors with their distance to
the page's pivot. A search takes pages from a queue by the least distance they
can hold, and stored distances rule out entries before theirs is computed:
|d(q, parent) - d(entry, parent)| less the radius is a lower bound already.
Every query, in blocks too, is searched in every tree, and the trees' best
are merged; products are whole numbers and decide, while the distances only
prune, with a margin for rounding, so the result is exact, ties included (for
components below 2^24 in size, whose products doubles hold exactly).

Defined cases: rows with a null id, a null vector or a null component take no
part, nor do empty vectors; vectors of another length than the query's are no
candidates; a row repeated with its id counts once, and different vectors of
one id count each, also as queries; no vector of a query's own id is its
candidate; fewer candidates than k give fewer rows; an empty table gives an
empty table. Only the id and the vector are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stage

BLOCK = 2048  # vectors in a tree, and queries that visit it together
PAGE = 64
MARGIN = 1e-9


@dataclass
class Page:
    """A node: entries' distances to its pivot, and either children or vectors."""

    pivot: np.ndarray
    radius: float
    to_pivot: np.ndarray
    rows: np.ndarray | None = None
    children: list["Page"] = field(default_factory=list)
    pivots: np.ndarray | None = None
    radii: np.ndarray | None = None


def distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - pivot) ** 2).sum(1), 0))


def build(points: np.ndarray, rows: np.ndarray, pivot: np.ndarray) -> Page:
    """Bulk loading: rows go to the nearest of some pivots, page by page."""
    own = distances(points[rows], pivot)
    radius = float(own.max(initial=0.0))
    if len(rows) <= PAGE:
        return Page(pivot, radius, own, rows=rows)
    ways = min(PAGE, -(-len(rows) // PAGE) * 2)
    pivots = points[rows[np.linspace(0, len(rows) - 1, ways).astype(int)]]
    near = np.argmin((pivots**2).sum(1) - 2 * points[rows] @ pivots.T, axis=1)
    if near.max() == near.min():  # equal points cannot be told apart
        near = np.arange(len(rows)) % ways
    children = [build(points, rows[near == k], pivots[k]) for k in range(ways) if (near == k).any()]
    pivots = np.array([c.pivot for c in children])
    return Page(pivot, radius, distances(pivots, pivot), children=children, pivots=pivots, radii=np.array([c.radius for c in children]))


def search(root: Page, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, lifted: np.ndarray, base: float, k: int) -> list[tuple[int, int]]:
    """The k best (product, id) of one tree, best first; ``base`` is |q|^2 + m."""
    best: list[tuple[int, int]] = []  # (product, -id), the worst on top
    slack = MARGIN * (base + 1)

    def reach() -> float:
        """The greatest distance that can still count."""
        return np.sqrt(max(base - 2 * best[0][0], 0.0) + slack) + slack if len(best) == k else np.inf

    d = float(distances(root.pivot[None], lifted)[0])
    queue, pushed = [(0.0, 0, d, root)], 1
    while queue:
        low, _, d, page = heapq.heappop(queue)
        far = reach()
        if low > far:
            break
        if page.rows is None:
            maybe = np.flatnonzero(np.abs(d - page.to_pivot) - page.radii <= far)
            to = distances(page.pivots[maybe], lifted)
            for i, x in zip(maybe.tolist(), to.tolist()):
                low = max(x - float(page.radii[i]), 0.0)
                if low <= far:
                    heapq.heappush(queue, (low, pushed, x, page.children[i]))
                    pushed += 1
            continue
        rows = page.rows[np.abs(d - page.to_pivot) <= far]
        rows = rows[ids[rows] != own]
        products = vectors[rows] @ query
        if len(best) == k:
            ok = products >= best[0][0]
            rows, products = rows[ok], products[ok]
        for entry in zip(products.tolist(), (-ids[rows]).tolist()):
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(p, -i) for p, i in sorted(best, reverse=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row that ``is_query``
    selects, against all rows; ``vector`` is an array of whole numbers (long)."""
    known = F.col(vec_id).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v"), is_query.alias("q")).where(known)
    rows = rows.withColumn("key", F.xxhash64("id", "v")).dropDuplicates(["id", "v"]).withColumn("size", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = stage(rows.withColumn("square", square), "vectors")
    total = rows.agg(F.count("*"), F.count_if("q"), F.max("square")).first()
    blocks, groups = max(1, -(-total[0] // BLOCK)), max(1, -(-total[1] // BLOCK))
    most = float(total[2] or 0)

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    block = F.pmod("key", F.lit(blocks)).cast("int").alias("block")
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("part")
    data = rows.select("id", "v", "size", block, every(groups, "part"))
    queries = rows.where("q").select("id", "v", "size", "key", group, every(blocks, "block"))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten().to_numpy().astype(np.int64)
        return flat.reshape(t.num_rows, -1)

    def find(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if data.num_rows and queries.num_rows:
            ids, ints = data.column("id").to_numpy(), matrix(data)
            points = ints.astype(float)
            lift = np.sqrt(np.maximum(most - (points**2).sum(1), 0))
            points = np.column_stack((points, lift))
            root = build(points, np.arange(len(ids)), points.mean(0))
            for own, key, q in zip(queries.column("id").to_pylist(), queries.column("key").to_pylist(), matrix(queries)):
                lifted = np.append(q.astype(float), 0.0)
                base = float(lifted @ lifted) + most
                out += [(own, key, i, p) for p, i in search(root, ids, ints, q, own, lifted, base, k)]
        columns = zip(*out) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "key", "vec_id", "score"])

    found = data.groupBy("block", "part", "size").cogroup(queries.groupBy("block", "part", "size")).applyInArrow(find, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
