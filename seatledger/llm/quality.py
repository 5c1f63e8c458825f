"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text gives a row of statistics (shares of byte classes, word and line
shapes, repetition), transformed so that they spread evenly. Each class keeps
its own mean and a covariance shrunk towards the pooled one and towards a
multiple of the identity; a document's score is the class posterior from the
difference of the two log densities (Mahalanobis distances by triangular
solves with the cached Cholesky factors), flattened by a share of labels
taken to be wrong.

Fitting reads only count, sum and cross products for each class, which each
task adds up: all labelled rows take part, none reach the driver.

Defined cases: a null text counts as empty and is scored like one; documents
without a label (or with a null one) do not train; several labels of one
document count as their majority, ties as 1; a repeated row is scored each
time; with no labelled row of some class every score is the share of label 1
(0.5 without any label). An empty table gives an empty table. Result columns
replace input columns of the same name; labels, language and source are never
read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import plain, plus, stage
from ._text import LOWER, slices, utf8, word_bounds, word_codes

SLICE = 1 << 20
# Byte classes: 0 lower case, 1 upper case, 2 digits, 3 white space but for
# line ends, 4 line ends, 5 sentence marks, 6 other ASCII marks, 7 beyond
# ASCII, 8 exclamation and question marks.
CLASSES = 9
CLASS = np.full(256, 6, np.uint8)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A], CLASS[0x80:] = 0, 1, 2, 7
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], CLASS[0x0A] = 3, 4
CLASS[[ord(c) for c in ".,;:'\"-()"]], CLASS[[ord(c) for c in "!?"]] = 5, 8
LETTER = (CLASS <= 1) | (CLASS == 7)

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "stops", "marks", "shouts", "beyond_ascii",
    "line_words", "marked_words", "capital_words", "bare_marks", "repeated_words", "top_word", "short_words",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each document of a run."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n) * CLASSES, size) + CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    starts, ends, doc = word_bounds(data, offsets)
    lens = ends - starts
    words = np.bincount(doc, minlength=n)
    per_word = lambda weights: np.bincount(doc, weights, n) / np.maximum(words, 1)
    mean = per_word(lens)
    spread = np.sqrt(np.maximum(per_word(lens.astype(float) ** 2) - mean**2, 0))
    letters = np.add.reduceat(LETTER[data].astype(np.int32), starts) if len(starts) else lens
    # reduceat runs on to the next word, over white space only
    uppers = np.add.reduceat((CLASS[data] == 1).astype(np.int32), starts) if len(starts) else lens
    last = CLASS[data[ends - 1]] if len(ends) else lens
    code = word_codes(LOWER[data], starts, ends)
    order = np.lexsort((code, doc))
    new = np.ones(len(order), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    kinds = np.bincount(doc[order][new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(order)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][new], runs)
    text = np.maximum(size, 1)
    lettered = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 7], 1)
    root = np.sqrt
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, spread, root(counts[:, 1] / lettered), root(counts[:, 2] / text), root(counts[:, 5] / text),
        root(counts[:, 6] / text), root(counts[:, 8] / text), root(counts[:, 7] / lettered), np.log1p(words / (counts[:, 4] + 1)),
        root(per_word((last == 6) | (last == 8))), root(per_word((uppers == letters) & (letters > 1))), root(per_word(letters == 0)),
        1 - kinds / np.maximum(words, 1), root(top / np.maximum(words, 1)), per_word(lens <= 3),
    ])


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """All columns but the text, plus an array of the statistics."""
    rest = docs.drop(out, text)
    names, where = rest.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(where))
            rows = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, SLICE)]
            x = np.concatenate([np.zeros((0, len(FEATURES))), *rows])
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), x.ravel())
            others = [c for i, c in enumerate(b.columns) if b.schema.names[i] in names]
            yield pa.RecordBatch.from_arrays([*others, lists], [*names, out])

    return docs.mapInArrow(run, plus(rest.schema, **{out: "array<double>"}))


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the inverse-scaled covariances, priors."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # inverses of the lower Cholesky factors
    log_terms: np.ndarray  # log prior - log determinant / 2
    share: float
    noise: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        far = [((z - m) @ f.T) for m, f in zip(self.means, self.factors)]
        logs = [t - 0.5 * np.einsum("ij,ij->i", d, d) for t, d in zip(self.log_terms, far)]
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        return self.noise + (1 - 2 * self.noise) * p


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float, ridge: float, noise: float) -> Discriminant:
    """From each class's count, sum and cross products. ``shrink`` moves a
    covariance to the pooled one, ``ridge`` that to its mean variance."""
    total, k = counts.sum(), sums.shape[1]
    share = float(counts[1] / total) if total else 0.5
    if min(counts) < 1:
        none = np.zeros((0, k))
        return Discriminant(np.zeros(k), np.ones(k), none, none, none, share, noise)
    centre = sums.sum(0) / total
    scale = np.sqrt(np.maximum(np.diag(products.sum(0)) / total - centre**2, 1e-12))
    means, spreads = [], []
    for n, s, q in zip(counts, sums, products):
        m = s / n
        means.append((m - centre) / scale)
        spreads.append((q / n - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / total
    factors, terms = [], []
    for n, c in zip(counts, spreads):
        c = (1 - shrink) * c + shrink * pooled
        c = (1 - ridge) * c + ridge * np.trace(c) / k * np.eye(k)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        terms.append(np.log(n / total) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(terms), share, noise)


def moments(rows: DataFrame, label: str, stats: str = "stats") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and cross products for labels 0 and 1: one row a task, then one sum."""
    k = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + k + k * k))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy().reshape(-1, k)
            for c in (0, 1):
                part = x[y == c]
                total[c] += np.concatenate(([len(part)], part.sum(0), (part.T @ part).ravel()))
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    sums = rows.select(F.col(label).cast("int"), stats).mapInArrow(run, "at long, v double")
    got = {r["at"]: r["v"] for r in sums.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    total = np.array([got.get(i, 0.0) for i in range(2 * (1 + k + k * k))]).reshape(2, -1)
    return total[:, 0], total[:, 1 : 1 + k], total[:, 1 + k :].reshape(2, k, k)


def one_label(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """One label for each document that has any: the majority, ties as 1."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    return known.groupBy(doc_id).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))


def learn(measured: DataFrame, labels: DataFrame, train: Column, label: str, shrink: float, ridge: float, noise: float, doc_id: str) -> Discriminant:
    """The model of the labelled rows among ``measured`` (with ``__stats``) that ``train`` allows."""
    learned = measured.where(train).select(doc_id, "__stats").join(one_label(labels, label, doc_id), doc_id)
    return fit(*moments(learned, "__label", "__stats"), shrink, ridge, noise)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    label: str = "quality",
    shrink: float = 0.3,
    ridge: float = 0.001,
    noise: float = 0.001,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` without the text plus ``score`` (that the label is 1); ``train``
    says which labelled rows may be learned from."""
    measured = stage(with_statistics(plain(docs).drop("score"), text, "__stats"), "stats")
    model = learn(measured, labels, train, label, shrink, ridge, noise, doc_id)
    rest = measured.drop("__stats")
    names, where = rest.columns, measured.columns.index("__stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(where).flatten().to_numpy().reshape(-1, len(FEATURES))
            others = [c for i, c in enumerate(b.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*others, pa.array(model.score(x))], [*names, "score"])

    return measured.mapInArrow(run, plus(rest.schema, score="double"))


def drop_low_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    least: float,
    label: str = "quality",
    shrink: float = 0.3,
    ridge: float = 0.001,
    noise: float = 0.001,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``. Learning reads
    the statistics of the rows that ``train`` allows; then each text is scored
    and kept or dropped where it is read, so no text is shuffled."""
    docs = plain(docs)
    model = learn(with_statistics(docs.select(doc_id, text).where(train), text, "__stats"), labels, F.lit(True), label, shrink, ridge, noise, doc_id)

    def high(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        scores = [model.score(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets, SLICE)]
        return pa.array(np.concatenate([np.zeros(0), *scores]) >= least)

    return docs.where(F.arrow_udf(high, "boolean")(text))  # only the text goes to Python, one boolean comes back
