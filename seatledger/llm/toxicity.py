"""Toxicity: a linear-chain conditional random field tags offending tokens.

Tokens are runs of letters and digits, A-Z lower-cased. Labels are known for
documents only, so token labels come from them: the smoothed log odds (less a
standard error) of a token's word and of its beginnings (3 to 8 bytes) between
the toxic and clean documents of one half of the sample are its evidence. In
the other half, a token of a toxic document with strong evidence is labelled
toxic, and every token of a clean document is labelled clean, whatever its
evidence; so chance finds of the first half count against their bin. The field
has a weight for each bin of evidence and one for two toxic tokens in a row,
fitted by gradient on the conditional likelihood.

Scoring runs forward and backward over each document. Tokens without any
evidence all share one transfer matrix, so a stretch of them is a power of
it, in closed form, and the recursions step from one token with evidence
to the next. The marginals add up to the document's statistics (their sum,
their maximum), which a logistic curve fitted on the labelled documents turns
into the score; tokens with a marginal of at least one half are the offending
spans (byte offsets in the UTF-8 text).

Words, weights and curve are fitted on a sample of about ``sample`` labelled
rows (all, if fewer), chosen by a hash of the id; equal texts count once. What
is learned is bounded by it. Every document is scored, whole.

Defined cases: a null or empty text has no tokens and the score of a document
without evidence; documents without label or id do not train; several
labels of one document count as their majority, ties as 1; without labels of
both kinds the score is the share of label 1 (0 without any); with one kind only in
either half, both halves are used twice. Repeated rows
are scored each; an empty table gives an empty table. Result columns replace
input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import plain, plus, stage
from ._text import BYTE_CODE, LOWER, MARK, MULTIPLIER, mix, powers, slices, utf8, word_bounds, word_codes
from .quality import one_label

BEGINNINGS = (3, 4, 5, 6, 7, 8)
BINS = 18  # 0: no evidence; then half a unit of log odds each, from LEAST
LEAST = 0.5
STRONG = 1.5  # log odds from which a token of a toxic document is labelled toxic
NEUTRAL = -6.0  # weight of a token without evidence
SLICE = 1 << 20


# ------------------------------------------------------------------ features
def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row for each token: codes of the word and its beginnings (0: too short)."""
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), np.uint64)
    if not len(starts):
        return out
    out[:, 0] = word_codes(data, starts, ends)
    sums, up = np.zeros(len(starts), np.uint64), powers(max(BEGINNINGS))
    for n in range(max(BEGINNINGS)):
        inside = ends - starts > n
        sums[inside] += BYTE_CODE[data[starts[inside] + n]] * up[n]
        if n + 1 in BEGINNINGS:
            out[inside, 1 + BEGINNINGS.index(n + 1)] = mix(sums[inside] * MULTIPLIER + np.uint64(n + 1))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, end, which distinct word) of all tokens, and the distinct words' features."""
    data = LOWER[data]
    starts, ends, doc = word_bounds(data, offsets, MARK)
    _, first, which = np.unique(word_codes(data, starts, ends), return_index=True, return_inverse=True)
    return doc, starts, ends, which, features(data, starts[first], ends[first])


@dataclass(frozen=True)
class Evidence:
    """Log odds by feature code, with a small table to pass over most codes quickly."""

    codes: np.ndarray
    odds: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, odds: np.ndarray) -> "Evidence":
        order = np.argsort(codes)
        maybe = np.zeros(1 << 20, bool)
        maybe[codes >> np.uint64(44)] = True
        return cls(codes[order], odds[order], maybe)

    def bins(self, found: np.ndarray) -> np.ndarray:
        """The bin of each row of feature codes, by its greatest log odds."""
        best = np.full(found.shape, -np.inf)
        r, c = np.nonzero(self.maybe[found >> np.uint64(44)])
        if len(r) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, found[r, c]), len(self.codes) - 1)
            hit = self.codes[at] == found[r, c]
            best[r[hit], c[hit]] = self.odds[at[hit]]
        best = best.max(1)
        return np.where(best < LEAST, 0, np.clip(2 * (best - LEAST) + 1, 1, BINS - 1)).astype(np.int64)


# ------------------------------------------------------------------ the field
@dataclass(frozen=True)
class Events:
    """Documents' tokens with evidence, padded: bins, and how many tokens without
    lie before each; those after the last; and how many there are."""

    bins: np.ndarray
    gaps: np.ndarray
    tail: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, doc: np.ndarray, at: np.ndarray, bins: np.ndarray, sizes: np.ndarray) -> "Events":
        """From the documents, places in them and bins of the tokens, in order."""
        n, count = len(sizes), np.bincount(doc, minlength=len(sizes))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        out = np.zeros((2, n, max(int(count.max(initial=0)), 1)), np.int64)
        out[0, doc, place] = bins
        before = np.where(place == 0, -1, np.concatenate(([0], at[:-1])))
        out[1, doc, place] = at - before - 1
        last = np.full(n, -1)
        last[doc] = at  # the last one stays
        return cls(out[0], out[1], sizes - last - 1, count)

    def live(self) -> np.ndarray:
        return np.arange(self.bins.shape[1])[None] < self.count[:, None]


def stretch(weights: np.ndarray, pair: float, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transfer matrix of ``n`` tokens without evidence, over l^n, and n log l
    (l the greater root): a + r^n b."""
    e = np.exp(weights[0])
    m = np.array([[1.0, e], [1.0, e * np.exp(pair)]])
    half, det = (m[0, 0] + m[1, 1]) / 2, m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
    root = np.sqrt(max(half * half - det, 1e-300))
    high, low = half + root, half - root
    a = (m - low * np.eye(2)) / (high - low)
    r = (low / high) ** np.maximum(n, 0)
    r = np.where(n == 0, 1.0, r)
    return a + r[:, None, None] * (np.eye(2) - a), n * np.log(high)


def marginals(ev: Events, weights: np.ndarray, pair: float, back: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic) of every event, log Z of every document), by forward and (for the first) backward steps."""
    n, width = ev.bins.shape
    live = ev.live()
    now, log_z = np.tile([1.0, 0.0], (n, 1)), np.zeros(n)
    steps, forward = [], np.zeros((n, width, 2))
    for k in range(width):
        over, logs = stretch(weights, pair, ev.gaps[:, k])
        e = np.exp(weights[ev.bins[:, k]])
        own = np.stack((np.ones((n, 2)), np.stack((e, e * np.exp(pair)), 1)), 2)
        step = np.where(live[:, k, None, None], over @ own, np.eye(2))
        new = np.einsum("ni,nij->nj", now, step)
        total = new.sum(1)
        now = new / total[:, None]
        log_z += np.log(total) + np.where(live[:, k], logs, 0)
        forward[:, k] = now
        steps.append(step)
    over, logs = stretch(weights, pair, ev.tail)
    behind = over.sum(2)
    log_z += np.log(np.einsum("ni,ni->n", now, behind)) + logs
    p = np.zeros((n, width))
    for k in range(width - 1, -1, -1) if back else ():
        both = forward[:, k] * behind
        p[:, k] = both[:, 1] / both.sum(1)
        behind = np.einsum("nij,nj->ni", steps[k], behind)
        behind /= behind.sum(1)[:, None]
    return np.where(live, p, 0), log_z


def fit_field(parts: list[tuple[Events, np.ndarray]], rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights of the bins and of a pair, by gradient ascent on the labels' likelihood."""
    weights, pair = np.linspace(-4, 3, BINS), 0.5
    weights[0] = NEUTRAL
    there, pairs = np.zeros(BINS), 0
    for ev, gold in parts:
        there += np.bincount(ev.bins[ev.live()], minlength=BINS)
        pairs += int((gold[:, 1:] & gold[:, :-1] & (ev.gaps[:, 1:] == 0)).sum())
    for k in range(rounds):
        rate, slope, more = 4.0 / (1 + 0.1 * k), np.zeros(BINS), 0.0
        for ev, gold in parts:
            live = ev.live()
            p, log_z = marginals(ev, weights, pair)
            slope += np.bincount(ev.bins[live], gold[live] - p[live], BINS)
            more += marginals(ev, weights, pair + 1e-4, back=False)[1].sum() - log_z.sum()
        pair = float(np.clip(pair + rate * (pairs - more / 1e-4) / max(there.sum(), 1) * 5, -3, 6))
        weights[1:] = np.clip(weights[1:] + rate * (slope / (there + 5.0))[1:], -8, 12)
    return weights, pair


def summary(p: np.ndarray, ev: Events) -> np.ndarray:
    """A document's statistics of its marginals."""
    total = p.sum(1)
    return np.column_stack((np.ones(len(p)), np.log1p(total), p.max(1, initial=0), np.log1p(ev.count), (p >= 0.5).sum(1) > 1))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * 0.1, x.T @ (y - p) - ridge * 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


# ------------------------------------------------------------------ operator
def events_of(data: np.ndarray, offsets: np.ndarray, evidence: Evidence) -> tuple[np.ndarray, ...]:
    """(document, place among its tokens, bin, start byte, end byte) of tokens with evidence, and documents' numbers of tokens."""
    got: list[tuple[np.ndarray, ...]] = []
    sizes = np.zeros(len(offsets) - 1, np.int64)
    for i, j in slices(offsets, SLICE):
        at = offsets[i : j + 1] - offsets[i]
        doc, starts, ends, which, found = tokens(data[offsets[i] : offsets[j]], at)
        sizes[i:j] = np.bincount(doc, minlength=j - i)
        place = np.arange(len(doc)) - (np.cumsum(sizes[i:j]) - sizes[i:j])[doc]
        bins = evidence.bins(found)[which]
        hit = np.flatnonzero(bins)
        got.append((doc[hit] + i, place[hit], bins[hit], starts[hit] - at[doc[hit]], ends[hit] - at[doc[hit]]))
    return *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got) if got else [[]] * 5)), sizes


def in_groups(count: np.ndarray, size: int = 256) -> Iterator[np.ndarray]:
    """Documents with about as many events together."""
    order = np.argsort(count, kind="stable")
    for i in range(0, len(order), size):
        yield order[i : i + size]


def within(group: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of the group's events among all."""
    n = count[group]
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group], n)


def pick(group: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray, bins: np.ndarray, sizes: np.ndarray) -> Events:
    mine = within(group, first, count)
    return Events.of(np.repeat(np.arange(len(group)), count[group]), at[mine], bins[mine], sizes[group])


def feature_counts(sample: DataFrame) -> DataFrame:
    """(code, toxic, clean): documents of the sample with each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            y = b.column("__label").to_numpy().astype(np.int64)
            got = []
            for i, j in slices(offsets, SLICE):
                doc, _, _, which, found = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                once = np.unique(doc * len(found) + which)
                doc, which = once // max(len(found), 1), once % max(len(found), 1)
                codes = found[which]
                pairs = np.unique(np.stack((codes.ravel(), np.repeat(doc, codes.shape[1]).astype(np.uint64))), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
                got.append((pairs[0], y[i:j][pairs[1].astype(np.int64)]))
            codes, label = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            code, at = np.unique(codes, return_inverse=True)
            n, toxic = np.bincount(at, minlength=len(code)), np.bincount(at, label, len(code)).astype(np.int64)
            some = code != 0
            yield pa.RecordBatch.from_arrays([pa.array(code[some].view(np.int64)), pa.array(toxic[some]), pa.array((n - toxic)[some])], ["code", "toxic", "clean"])

    parts = sample.mapInArrow(run, "code long, toxic long, clean long")
    return parts.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = 20_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without the text plus ``score`` and ``spans`` (start, end, marginal
    of each offending token); ``train`` says which labelled rows may be learned from."""
    docs = plain(docs).drop("score", "spans")
    # the labels of about ``sample`` documents: a bounded table
    usable = one_label(labels, label, doc_id).where(train)
    share = min(1.0, sample / max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < share * (1 << 20))
    learned = docs.select(F.col(doc_id), F.col(text).alias("text")).join(F.broadcast(chosen), doc_id).select("text", "__label")
    learned = stage(learned.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(F.first("text").alias("text"), F.max("__label").alias("__label")), "labelled")
    learned = learned.select("text", "__label", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(2)).cast("int").alias("half"))
    totals = {(r["half"], r["__label"]): r["n"] for r in learned.groupBy("half", "__label").agg(F.count("*").alias("n")).collect()}
    toxic_all, all_ = sum(n for (_, y), n in totals.items() if y), sum(totals.values())
    first, second = learned.where("half = 0"), learned.where("half = 1")
    toxic, clean = totals.get((0, 1), 0), totals.get((0, 0), 0)
    if len(totals) < 4:
        first = second = learned
        toxic, clean = toxic_all, all_ - toxic_all
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = feature_counts(first).where("toxic > 1").select("code", (odds - spread).alias("odds")).where(F.col("odds") >= LEAST)
    rows = strong.toPandas()  # of the sample's words
    evidence = Evidence.of(rows["code"].to_numpy(np.int64).view(np.uint64), rows["odds"].to_numpy(float))

    def list_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            doc, at, bins, _, _, sizes = events_of(data, offsets, evidence)
            cuts = np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("__label"), pa.array(sizes), *(pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (at, bins))], ["y", "size", "at", "bins"])

    share1 = toxic_all / max(all_, 1)
    weights = pair = curve = None
    if 0 < toxic_all < all_:
        got = second.select("text", "__label").mapInArrow(list_events, "y int, size long, at array<long>, bins array<long>").toPandas()  # the sample's
        y, count = got["y"].to_numpy(int), got["at"].str.len().to_numpy(int)
        flat = [np.concatenate([np.zeros(0, np.int64), *got[k]]) for k in ("at", "bins")]
        size, first, parts = got["size"].to_numpy(int), np.cumsum(count) - count, []
        for group in in_groups(count, 1024):
            ev = pick(group, first, count, *flat, size)
            parts.append((ev, (ev.bins >= 2 * (STRONG - LEAST) + 1) & (y[group][:, None] == 1)))
        weights, pair = fit_field(parts)
        x = np.concatenate([summary(marginals(ev, weights, pair)[0], ev) for ev, _ in parts])
        curve = fit_curve(x, np.concatenate([y[group] for group in in_groups(count, 1024)]))

    rest = docs.drop(text)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(text))
            doc, at, bins, starts, ends, sizes = events_of(data, offsets, evidence)
            n = len(sizes)
            score, chance = np.full(n, share1), np.zeros(len(doc))
            count = np.bincount(doc, minlength=n)
            first = np.cumsum(count) - count
            for group in in_groups(count) if curve is not None else ():
                ev = pick(group, first, count, at, bins, sizes)
                p, _ = marginals(ev, weights, pair)
                chance[within(group, first, count)] = p[ev.live()]
                score[group] = 1 / (1 + np.exp(-np.clip(summary(p, ev) @ curve, -500, 500)))
            bad = np.flatnonzero(chance >= 0.5)
            cuts = np.searchsorted(doc[bad], np.arange(n + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(starts[bad]), pa.array(ends[bad]), pa.array(chance[bad])], ["start", "end", "marginal"])
            others = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*others, pa.array(score), pa.ListArray.from_arrays(cuts, spans)], [*names, "score", "spans"])

    schema = plus(rest.schema, score="double", spans="array<struct<start:long,end:long,marginal:double>>")
    return docs.mapInArrow(run, schema)
