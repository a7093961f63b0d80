"""Lower bounds of alignment p-values, for many queries and targets at once.

Columns of targets are put into cells, boxes of near columns, and a query's column has with all columns of a cell no higher a
score than with the box.  So the score of an alignment has an upper bound that is a sum of numbers looked up by cell, and the
p-value a lower one.  Queries of one length are looked up together.

A bound only tells which targets need not be aligned exactly; it never stands for a p-value.
"""

from __future__ import annotations

import heapq

import numpy as np

from tessera.operators.align import SCORES

#: Cells that the columns of a group of targets are put into at most, and columns that the cells are made from.
CELLS, CELLS_FROM = 1024, 1 << 14
#: Queries looked up together: numbers of two bytes in one element.
LANES = 16
TOGETHER = np.dtype(f"V{2 * LANES}")
#: Targets at work at a time.
AT_ONCE = 512
#: Longest query whose sums fit in two bytes; a longer one has zero as its bound.
LONGEST = ((1 << 15) - 1) // SCORES
#: What is added to a probability in single precision, so that it is none too low, and what a bound may exceed its p-value by for all that.
ABOVE, SLACK = 3e-7, 4e-6


class Cells:
    """Boxes around near columns (n, 4), and the box that each column lies in."""

    def __init__(self, columns: np.ndarray, most: int = CELLS):
        sample = columns[:: max(1, -(-len(columns) // CELLS_FROM))]
        sample = np.nan_to_num(sample, nan=0.0)
        axis, cut, after = [0], [np.inf], [[0, 0]]
        extent = lambda s: (lambda w: (-float(w.max()), int(w.argmax())))(s.max(0) - s.min(0))
        heap = [(*extent(sample), 0, sample)] if len(sample) else []
        leaves = 1
        # The widest box is cut in the middle of its widest side.
        while heap and leaves < most:
            width, side, node, part = heapq.heappop(heap)
            if not width < 0:
                continue
            x = part[:, side]
            at = x.min() / 2 + x.max() / 2
            less = x < at
            if not less.any():
                continue
            axis[node], cut[node], after[node] = side, at, [len(axis), len(axis) + 1]
            for half in (part[less], part[~less]):
                heapq.heappush(heap, (*extent(half), len(axis), half))
                axis.append(0), cut.append(np.inf), after.append([len(axis) - 1] * 2)
            leaves += 1
        axis, cut, after = np.array(axis), np.array(cut), np.array(after)
        node = np.zeros(len(columns), int)
        inner = after[:, 0] != np.arange(len(after))
        if inner.any():
            moving = np.arange(len(columns))
            while len(moving):
                at = node[moving]
                node[moving] = after[at, (~(columns[moving, axis[at]] < cut[at])).astype(int)]
                moving = moving[inner[node[moving]]]
        used, self.codes = np.unique(node, return_inverse=True)
        order = np.argsort(self.codes, kind="stable")
        begins = np.searchsorted(self.codes[order], np.arange(len(used)))
        self.low, self.high = (f.reduceat(columns[order], begins) for f in (np.minimum, np.maximum))

    def highest(self, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """An upper bound of the binned score of each column (n, 4) with the columns of each box."""
        out = np.empty((len(query), len(self.low)), np.int16)
        width = np.where(high > low, high - low, 1)
        for k in range(0, len(query), 4):  # what is at work stays in the cache
            d = np.zeros((len(query[k : k + 4]), len(self.low)))
            for base in range(4):
                own = query[k : k + 4, base, None]
                gap = np.maximum(self.low[:, base] - own, own - self.high[:, base])
                np.maximum(gap, 0, out=gap)
                d += np.multiply(gap, gap, out=gap)
            np.sqrt(d, out=d)
            np.subtract(-low[k : k + 4, None], d, out=d)
            d *= (SCORES / width[k : k + 4])[:, None]
            d += 1e-6
            np.rint(d, out=d)
            out[k : k + 4] = np.fmax(np.fmin(d, SCORES, out=d), 0, out=d)  # what is no number has the highest
        return out


class Group:
    """Targets as cells of their columns: by length, in pieces of ``AT_ONCE``: (places among the targets, cells by position)."""

    def __init__(self, columns: np.ndarray, lengths: np.ndarray):
        self.n, self.cells, self.pieces = len(lengths), Cells(columns), {}
        begins = np.cumsum(lengths) - lengths
        for length in np.unique(lengths[lengths > 0]).tolist():
            same = np.flatnonzero(lengths == length)
            parts = [same[k : k + AT_ONCE] for k in range(0, len(same), AT_ONCE)]
            self.pieces[length] = [(p, np.ascontiguousarray(self.cells.codes[begins[p] + np.arange(length)[:, None]])) for p in parts]


def _overlaps(m: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last but one column of the query under a target of ``length``, for each place that it may lie at."""
    k = np.arange(m + length - 1)
    return np.maximum(0, m - 1 - k), np.minimum(m, length + m - 1 - k)


def _rest(counts: np.ndarray, spans: np.ndarray, most: int) -> np.ndarray:
    """1 - ``align._tails`` of the nulls (n, m, scores) of queries of one length, (spans, n, most * SCORES + 1), in single
    precision and a little above."""
    n, m = counts.shape[:2]
    size = 1 << int(m * SCORES + 1).bit_length()
    parts = np.fft.rfft(counts / counts[:, :1].sum(2, keepdims=True), size, axis=2)
    at = {int(x): k for k, x in enumerate(spans)}
    last = dict(divmod(int(x), m + 1) for x in spans)  # spans ascend
    products = np.empty((len(spans), n, parts.shape[2]), complex)
    for a, end in last.items():
        running = parts[:, a]
        for b in range(a + 1, end + 1):
            if b > a + 1:
                running = running * parts[:, b - 1]
            if a * (m + 1) + b in at:
                products[at[a * (m + 1) + b]] = running
    out = np.empty((len(spans), n, most * SCORES + 1), np.float32)
    out[:, :, 0] = ABOVE
    for row, product in zip(out, products, strict=True):
        below = np.cumsum(np.fft.irfft(product, size, axis=1)[:, : most * SCORES], axis=1)
        row[:, 1:] = np.add(below, ABOVE, out=below)
    return out


def lower_bounds(queries: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], group: Group) -> np.ndarray:
    """For each target the sum over queries (matrix (4, m), low, high, counts (m, scores)) of lower bounds of its p-value."""
    total = np.zeros(group.n)
    by_length: dict[int, list] = {}
    for q in queries:
        if 0 < q[0].shape[1] <= LONGEST:
            by_length.setdefault(q[0].shape[1], []).append(q)
    if not group.pieces:
        return total
    widest = max(len(places) for pieces in group.pieces.values() for places, _ in pieces) * LANES
    indices, value = np.empty(widest, np.intp), np.empty(widest, np.float32)
    for m, same in by_length.items():
        overlaps = {length: _overlaps(m, length) for length in group.pieces}
        spans = np.unique(np.concatenate([first * (m + 1) + stop for first, stop in overlaps.values()]))
        first, stop = np.divmod(spans, m + 1)
        most = int((stop - first).max())
        rows = {length: np.searchsorted(spans, a * (m + 1) + b).tolist() for length, (a, b) in overlaps.items()}
        lanes = np.tile(np.arange(LANES) * (most * SCORES + 1), widest // LANES)
        sums = np.empty((2, m + max(group.pieces) - 1, widest), np.int16)
        for k in range(0, len(same), LANES):
            batch = same[k : k + LANES]
            tables = np.zeros((2, m, len(group.cells.low), LANES), np.int16)
            for lane, (matrix, low, high, _) in enumerate(batch):
                tables[0, :, :, lane] = group.cells.highest(matrix.T, low, high)
                tables[1, :, :, lane] = group.cells.highest(matrix.T[:, ::-1], low, high)[::-1]
            rest = _rest(np.stack([counts for _, _, _, counts in batch]), spans, most).reshape(len(spans), -1)
            looked_up = tables.reshape(2, m, -1).view(TOGETHER)
            for length, pieces in group.pieces.items():
                at, last = rows[length], m + length - 1
                for places, codes in pieces:
                    n = len(places) * LANES
                    here = sums[:, :last, :n]
                    here[:] = 0
                    found = np.empty(codes.shape, TOGETHER)
                    numbers = found.view(np.int16)
                    for strand in (0, 1):
                        for i in range(m):
                            looked_up[strand, i].take(codes, out=found, mode="clip")
                            part = here[strand, m - 1 - i : m - 1 - i + length]
                            np.add(part, numbers, out=part)
                    # The query's reverse complement lies at a place as the query lies at the mirrored one.
                    highest = np.maximum(here[0], here[1, ::-1])
                    q, index, x = np.zeros(n, np.float32), indices[:n], value[:n]
                    lo = 0
                    while lo < last:  # places of one span, the target within the whole query, follow each other
                        hi = lo + 1
                        while hi < last and at[hi] == at[lo]:
                            hi += 1
                        top = highest[lo] if hi == lo + 1 else highest[lo:hi].max(0)
                        np.add(top, lanes[:n], out=index)
                        rest[at[lo]].take(index, out=x, mode="clip")
                        np.maximum(q, x, out=q)
                        lo = hi
                    tried, power = 2 * last, np.ones_like(q)
                    while tried:
                        if tried & 1:
                            power *= q
                        q *= q
                        tried >>= 1
                    total[places] += (1 - power.reshape(-1, LANES)[:, : len(batch)]).sum(1, dtype=float)
    return total
