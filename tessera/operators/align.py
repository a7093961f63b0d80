"""Motif alignment p-values after Gupta et al. 2007 (Genome Biology 8:R24).

The score of two columns is the negative Euclidean distance, shifted and binned to integers per query column, with the
columns of all targets as its null.  An ungapped alignment's score is the sum over the columns of the query that overlap the
target; its null is the convolution of those columns' nulls, and its p-value the upper tail.  A target keeps its best offset
over both strands, corrected for the number of offsets tried.  A query's result depends on the targets only.

A query is scored against all targets at once.  Equal columns of targets are numbered once; the targets lie in one row with
gaps between them, so that the scores of all offsets are as many shifted sums as the query has columns; the tails of all spans
are one table that the scores look up.

The null needs the extremes of each query column and then its histogram.  Both add up over parts of the targets, so targets too
many for one task are met part by part: ``extremes``, ``binned`` and ``histogram``, ``score``.  ``align`` does all three with the targets at hand.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.shared import materialise

SCORES = 100
#: A collection of 18,000 motifs of 12 positions has 7 MB.
MOST_BYTES = 256 << 20
#: Lengths of queries that the targets are laid out for at a time.
LAYOUTS = 4
#: Different columns of targets that are compared at a time.
CHUNK = 4096
#: Lines that columns of targets are kept by at most, and columns that a line must have.
LINES, LINE_POINTS = 16, 64


class Layout:
    """The targets for queries of ``m`` columns: in a row, with m - 1 gaps before, between and behind them.

    Place p stands for one offset of one target: ``columns[s, p + i]`` is the column (of strand s) under the query's column i,
    or the gap.  Places of a target follow each other from ``begins`` on, by ascending offset.
    """

    def __init__(self, targets: Targets, m: int):
        lengths = targets.lengths
        places = lengths + m - 1
        ends = np.cumsum(places)
        self.begins = ends - places
        self.columns = np.full((2, int(ends[-1]) + m - 1), len(targets.distinct), np.int32)
        at = np.repeat(self.begins + m - 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        self.columns[:, at] = targets.numbers
        owner = np.repeat(np.arange(len(lengths)), places)
        self.offsets = np.arange(int(ends[-1])) - self.begins[owner] - m + 1
        self.first = np.maximum(0, -self.offsets)
        self.stop = np.minimum(m, lengths[owner] - self.offsets)
        self.owner = owner
        self.spans, span = np.unique(self.first * (m + 1) + self.stop, return_inverse=True)
        first, stop = np.divmod(self.spans, m + 1)
        self.most = int((stop - first).max())  # columns that meet a target, no more than the longest target has
        self.row = span.astype(np.int64) * (self.most * SCORES + 1)  # of the table of tails


class Targets:
    """All targets, forward and reverse complement: their different columns, how often each occurs, and the column at each
    position of either strand."""

    def __init__(self, motifs: list[np.ndarray]):
        self.lengths = np.array([m.shape[1] for m in motifs], int)
        columns = np.concatenate([m.T for m in motifs] + [m.T[::-1, ::-1] for m in motifs]) if motifs else np.zeros((0, 4))
        self.distinct, numbers = np.unique(columns, axis=0, return_inverse=True)
        self.numbers = numbers.reshape(2, -1)
        self.counts = np.bincount(numbers.reshape(-1), minlength=len(self.distinct))
        self.bases = np.ascontiguousarray(self.distinct.T)
        self._layouts: dict[int, Layout] = {}

    def layout(self, m: int) -> Layout:
        if m not in self._layouts:
            if len(self._layouts) >= LAYOUTS:
                self._layouts.pop(next(iter(self._layouts)))
            self._layouts[m] = Layout(self, m)
        return self._layouts[m]


def _scores(query: np.ndarray, targets: Targets) -> np.ndarray:
    """Of each column of the query (4, m) with each different column of the targets: the negative distance."""
    return _distances(query.T, targets.bases)


def _distances(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each column (n, 4) with each of (4, k): the negative distance."""
    out = np.empty((len(query), points.shape[1]))
    for lo in range(0, out.shape[1], CHUNK):  # what is at work stays in the cache
        here = out[:, lo : lo + CHUNK]
        for base, (own, theirs) in enumerate(zip(query.T, points[:, lo : lo + CHUNK], strict=True)):
            d = own[:, None] - theirs[None]
            if base:
                here += np.multiply(d, d, out=d)
            else:
                np.multiply(d, d, out=here)
        np.negative(np.sqrt(here, out=here), out=here)
    return out


def _bins(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Binned scores; a last column of zeros stands for a gap."""
    width = np.where(high > low, high - low, 1)
    out = np.zeros((len(raw), raw.shape[1] + 1), np.int16)
    for lo in range(0, raw.shape[1], CHUNK):
        x = raw[:, lo : lo + CHUNK] - low[:, None]
        x /= width[:, None]
        x *= SCORES
        out[:, lo : lo + x.shape[1]] = np.rint(x, out=x)
    return out


class Line:
    """Points on a line through the origin, up to rounding: the different ones, in order of their place on it."""

    def __init__(self, points: np.ndarray, direction: np.ndarray):
        counts = pd.DataFrame(points).groupby([0, 1, 2, 3], sort=False).size()
        points, weights = counts.index.to_frame().to_numpy(), counts.to_numpy()
        places = points @ direction
        order = np.argsort(places, kind="stable")
        self.direction, self.points, self.places, self.weights = direction, np.ascontiguousarray(points[order].T), places[order], weights[order]
        self.before = np.concatenate([[0], np.cumsum(self.weights)])

    def seen_from(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of points (n, 4): the place next to each, and the distance there."""
        t = query @ self.direction
        return t, np.sqrt(((query - t[:, None] * self.direction) ** 2).sum(1))


def _ragged(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places of the ranges."""
    n = np.maximum(stop - first, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, first[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]


def _paired(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """``_scores`` of columns (n, 4) with one column each, (4, n), by the same steps and so to the same bits."""
    out = np.zeros(len(query))
    for base in range(4):
        d = query[:, base] - points[base]
        out = out + d * d if base else d * d
    return -np.sqrt(out)


class Columns:
    """The columns of targets, of both strands, as the null of a query's columns sees them.

    Where many columns are multiples of one (one base's attribution at each position, or one weight for each base), they are
    kept by line and counted by binary search: a column of a query costs a few hundred searches, not a distance to each.  A
    point too near an edge of a bin for that, and every column on no line, is compared itself, so extremes and histograms
    are those of ``extremes`` and ``histogram`` to the last bit."""

    def __init__(self, forward: np.ndarray):
        rest = np.concatenate([forward, forward[:, ::-1]])
        self.n, self.lines = len(rest), []
        norms = np.sqrt((rest * rest).sum(1))
        self.reach = float(np.nanmax(norms, initial=0))
        least = max(LINE_POINTS, len(rest) // 64)
        while len(self.lines) < LINES and len(rest) >= least:
            some, best = rest[:: -(-len(rest) // 4096)], (0, None)
            for lead in some[np.linspace(0, len(some) - 1, 8).astype(int)]:
                size = np.sqrt((lead * lead).sum())
                if 0 < size < np.inf:
                    best = max(best, (self._on(some, lead / size).sum(), lead / size), key=lambda x: x[0])
            if not best[0]:
                break
            direction = best[1]
            on = self._on(rest, direction)
            if on.sum() < least:
                break
            self.lines.append(Line(rest[on], direction))
            rest = rest[~on]
        self.rest = None
        if len(rest):
            distinct, counts = np.unique(rest, axis=0, return_counts=True)
            self.rest = np.ascontiguousarray(distinct.T), counts

    def _on(self, points: np.ndarray, direction: np.ndarray) -> np.ndarray:
        off = points - (points @ direction)[:, None] * direction
        return np.einsum("ij,ij->i", off, off) <= (1e-13 * self.reach) ** 2

    def _margin(self, query: np.ndarray) -> np.ndarray:
        return 1e-11 * (self.reach + np.sqrt((query * query).sum(1)))

    def extremes(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and the highest score of each column (n, 4)."""
        low, high = np.full(len(query), np.inf), np.full(len(query), -np.inf)
        if self.rest is not None:
            for k in range(0, len(query), 64):
                raw = _distances(query[k : k + 64], self.rest[0])
                low[k : k + 64], high[k : k + 64] = raw.min(1), raw.max(1)
        near = self._margin(query)
        for line in self.lines:
            t, h = line.seen_from(query)
            last = len(line.places) - 1
            far = np.hypot(np.maximum(np.abs(line.places[0] - t), np.abs(line.places[-1] - t)), h)
            s = np.sqrt(np.maximum((far - near) ** 2 - h * h, 0))
            at = np.searchsorted(line.places, t)
            close = np.hypot(np.minimum(np.abs(line.places[np.maximum(at - 1, 0)] - t), np.abs(line.places[np.minimum(at, last)] - t)), h)
            c = np.sqrt(np.maximum((close + near) ** 2 - h * h, 0)) + near
            ranges = [(np.zeros(len(t), int), np.searchsorted(line.places, t - s, "right")), (np.searchsorted(line.places, t + s, "left"), np.full(len(t), last + 1))]
            ranges.append((np.searchsorted(line.places, t - c, "left"), np.searchsorted(line.places, t + c, "right")))
            for first, stop in ranges:
                for k in range(0, len(t), 1024):
                    owner, place = _ragged(first[k : k + 1024], stop[k : k + 1024])
                    raw = _paired(query[owner + k], line.points[:, place])
                    np.minimum.at(low, owner + k, raw)
                    np.maximum.at(high, owner + k, raw)
        return low, high

    def histogram(self, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Counts of the columns by binned score, for each column (n, 4)."""
        out = np.zeros((len(query), SCORES + 1), np.int64)
        narrow = ~(high - low > 1e-6 * (self.reach + np.sqrt((query * query).sum(1))))
        for k in range(0, len(query), 256):
            some = k + np.flatnonzero(~narrow[k : k + 256])
            for line in self.lines:
                if len(some):
                    out[some] += self._on_line(line, query[some], low[some], high[some])
        parts = [(self.rest[0], self.rest[1], np.arange(len(query)))] if self.rest is not None else []
        parts += [(line.points, line.weights, np.flatnonzero(narrow)) for line in self.lines]
        for points, weights, which in parts:
            for k in range(0, len(which), 64):
                own = which[k : k + 64]
                bins = _bins(_distances(query[own], points), low[own], high[own])
                for i, b in zip(own, bins[:, :-1], strict=True):
                    out[i] += np.bincount(b, weights, SCORES + 1).astype(np.int64)
        return out

    def _on_line(self, line: Line, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        t, h = (x[:, None] for x in line.seen_from(query))
        near, width = self._margin(query)[:, None], (high - low)[:, None]
        # Distances at the edges between one bin and the next, descending; what lies within the margin of one is compared itself.
        edges = -(low[:, None] + (np.arange(SCORES) + 0.5) / SCORES * width)
        reach = lambda e: np.sqrt(np.maximum(e * e - h * h, 0))
        middle = np.broadcast_to(np.searchsorted(line.places, t), edges.shape)
        outer, inner = edges + near, edges - near
        left, right = (np.searchsorted(line.places, t + sign * reach(outer), side) for sign, side in ((-1, "left"), (1, "right")))
        left, right = np.where(outer < h, middle, left), np.where(outer < h, middle, right)
        s = reach(inner)
        tangent = inner <= h
        last = len(line.places) - 1
        more = left < right
        sure_left, sure_right = left.copy(), right.copy()
        for sure, doubt, edge, side in ((sure_left, more & (line.places[np.minimum(left, last)] < t - s), t - s, "left"), (sure_right, more & (line.places[np.maximum(right - 1, 0)] > t + s), t + s, "right")):
            at = np.nonzero(doubt)
            sure[at] = np.searchsorted(line.places, edge[at], side)
        sure_left, sure_right = np.where(tangent, np.clip(middle, left, right), sure_left), np.where(tangent, np.clip(middle, left, right), sure_right)
        within, sure = line.before[right] - line.before[left], line.before[sure_right] - line.before[sure_left]
        out = np.empty((len(query), SCORES + 1), np.int64)
        out[:, 0] = line.before[-1] - within[:, 0]
        out[:, 1:-1] = sure[:, :-1] - within[:, 1:]
        out[:, -1] = sure[:, -1]
        for first, stop in ((left, sure_left), (sure_right, right)):
            owner, place = _ragged(first.reshape(-1), stop.reshape(-1))
            if len(owner):
                q = owner // SCORES
                x = _paired(query[q], line.points[:, place]) - low[q]
                x /= width[q, 0]
                x *= SCORES
                np.add.at(out, (q, np.rint(x).astype(int)), line.weights[place])
        return out


def extremes(query: np.ndarray, targets: Targets) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest score of each column of the query."""
    raw = _scores(query, targets)
    return raw.min(1), raw.max(1)


def binned(query: np.ndarray, targets: Targets, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _bins(_scores(query, targets), low, high)


def histogram(bins: np.ndarray, targets: Targets) -> np.ndarray:
    """Counts of the targets' columns by binned score, for each column of the query."""
    return np.stack([np.bincount(b, targets.counts, SCORES + 1) for b in bins[:, :-1]]).astype(np.int64)


def _tails(counts: np.ndarray, spans: np.ndarray, most: int) -> np.ndarray:
    """P(sum over columns a .. b - 1 is at least s), a row for each span a * (m + 1) + b of ``most`` columns at most, for each s:
    products of Fourier transforms of the columns' nulls."""
    m = len(counts)
    single = counts / counts[0].sum()
    size = 1 << int(m * SCORES + 1).bit_length()  # the same for all parts of the targets
    parts = np.fft.rfft(single, size, axis=1)
    first, stop = np.divmod(spans, m + 1)
    products = np.empty((len(spans), parts.shape[1]), complex)
    at = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(first, stop, strict=True))}
    last = dict(zip(first.tolist(), stop.tolist(), strict=True))  # spans ascend
    for a, end in last.items():
        running = parts[a]
        for b in range(a + 1, end + 1):
            if b > a + 1:
                running = running * parts[b - 1]
            if (a, b) in at:
                products[at[a, b]] = running
    pdf = np.fft.irfft(products, size, axis=1)[:, : most * SCORES + 1]
    np.maximum(pdf, 0, out=pdf)
    for row, n in zip(pdf, ((stop - first) * SCORES + 1).tolist(), strict=True):
        row[n:] = 0
    out = np.empty(pdf.shape)
    np.cumsum(pdf[:, ::-1], 1, out=out[:, ::-1])
    return np.minimum(out, 1, out=out)


def score(bins: np.ndarray, targets: Targets, counts: np.ndarray, places: bool = True) -> tuple[np.ndarray, ...]:
    """(p, score, offset, overlap, strand) of a query, binned, against each target under a null, or (p,) without ``places``.

    Offset: of the query's first column in the target (its reverse complement, for strand 1).  Of equal p-values the higher
    score, the forward strand, the lower offset wins."""
    m = len(bins)
    at = targets.layout(m)
    tails = _tails(counts, at.spans, at.most).reshape(-1)
    best = None
    for strand in (0, 1):
        columns, n = at.columns[strand], len(at.offsets)
        totals = np.zeros(n, np.int16 if m * SCORES < 1 << 15 else np.int32)
        for i in range(m):
            totals += bins[i].take(columns[i : i + n])
        values = tails.take(at.row + totals)
        p = np.minimum.reduceat(values, at.begins)
        if not places:
            best = p if best is None else np.minimum(best, p)
            continue
        lowest = values == p[at.owner]
        top = np.maximum.reduceat(np.where(lowest, totals, -1), at.begins)
        where = np.minimum.reduceat(np.where(lowest & (totals == top[at.owner]), np.arange(n), n), at.begins)
        found = np.stack([top, at.offsets[where], (at.stop - at.first)[where], np.full(len(p), strand)])
        if best is None:
            best = p, found
        else:
            other = (p < best[0]) | ((p == best[0]) & (top > best[1][0]))
            best = np.where(other, p, best[0]), np.where(other, found, best[1])
    tried = 2 * (targets.lengths + m - 1)
    if not places:
        return (1 - (1 - best) ** tried,)
    return 1 - (1 - best[0]) ** tried, *best[1]


def align(query: np.ndarray, targets: Targets, places: bool = True) -> tuple[np.ndarray, ...]:
    """``score`` under the null that the targets make; empty queries and empty collections give p-values of one."""
    n, m = len(targets.lengths), query.shape[1]
    if not n or not m:
        return (np.ones(n), *(np.zeros(n, int) for _ in range(4)))[: 5 if places else 1]
    raw = _scores(query, targets)
    bins = _bins(raw, raw.min(1), raw.max(1))
    return score(bins, targets, histogram(bins, targets), places)


def _matrix(rows: Iterable) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in rows])


def similarity(seqlets: DataFrame, motifs: list[np.ndarray], chunk_size: int | None = None, n_nearest: int | None = None) -> DataFrame:
    """(seqlet_id, sim): clipped -log10 p against all motifs, in their order.

    The motif collection, a fixed reference set of ``MOST_BYTES`` at most, is sent to the tasks; the product of seqlets and
    motifs is never shuffled.  A larger collection is to be aligned part by part, as a seqlet's null is that of its targets.
    ``chunk_size`` is the number of seqlets handled at a time.  ``n_nearest`` keeps (motif_idx, sim) of the nearest only.
    """
    size = sum(m.nbytes for m in motifs)
    if size > MOST_BYTES:
        raise ValueError(f"a motif collection of {size} bytes is too large for one task")
    shared = seqlets.sparkSession.sparkContext.broadcast(motifs)

    def run(batches):
        targets = Targets(shared.value)
        for pdf in batches:
            for k in range(0, len(pdf), chunk_size or len(pdf) or 1):
                part = pdf.iloc[k : k + (chunk_size or len(pdf))]
                queries = [_matrix(m) for m in part["seqlet_matrix"]]
                found: list = [None] * len(queries)
                for i in sorted(range(len(queries)), key=lambda i: queries[i].shape[1]):  # so that layouts are used again
                    found[i] = align(queries[i], targets, places=False)[0].tolist()
                yield pd.DataFrame({"seqlet_id": part["seqlet_id"], "p": found})

    # The kernel costs far more than moving its rows, so they are dealt out evenly: adaptive execution would gather small
    # inputs in one task.  The result is kept, as the clip needs its maximum first.
    n = int(seqlets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = seqlets.select("seqlet_id", "seqlet_matrix").repartition(n, "seqlet_id")
    raw = materialise(dealt.mapInPandas(run, "seqlet_id long, p array<double>").select("seqlet_id", F.transform("p", A.log_similarity).alias("sim")), "similarity")
    top = raw.agg(F.max(F.array_max("sim"))).first()[0]
    if top is None:
        return raw
    out = raw.select("seqlet_id", F.transform("sim", lambda x: A.clip(x, F.lit(top))).alias("sim"))
    return nearest(out, n_nearest) if n_nearest else out


def nearest(similarity: DataFrame, n: int) -> DataFrame:
    """(seqlet_id, nearest): the ``n`` motifs most similar to a seqlet as (motif_idx, sim), the first of equals first."""
    pairs = F.transform("sim", lambda x, i: F.struct((-x).alias("less"), i.alias("motif_idx")))
    best = F.slice(F.array_sort(pairs), 1, n)
    return similarity.select("seqlet_id", F.transform(best, lambda s: F.struct(s["motif_idx"].alias("motif_idx"), (-s["less"]).alias("sim"))).alias("nearest"))
