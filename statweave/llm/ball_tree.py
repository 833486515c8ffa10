"""A ball tree over sparse rows, searched best-first for the largest inner products.

A node covers rows around a centroid; by Cauchy-Schwarz no row in it has an inner
product with q over q.centroid + |q| radius, where of q only the coordinates count
that some row of the node has, which are those of the centroid.  Scaling a coordinate of the rows and
dividing that of q by the same keeps inner products; with the square root of the
weight the radius follows the heavy coordinates.  Bounds are floating point and
rounded up by more than their error; scores at the leaves are whole numbers.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 16
# Relative error allowed for sums of up to this many products, far over what they have.
SLACK = 1e-9


def _take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of several runs, one behind the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class BallTree:
    """Rows in CSR form: ``first`` (row starts, one more than rows), ``columns``, whole ``values`` > 0; ``scale`` per column.

    No row may be empty.  ``order`` tells the row at each place of the tree.
    """

    def __init__(self, first: np.ndarray, columns: np.ndarray, values: np.ndarray, scale: np.ndarray, leaf: int = LEAF):
        n, self.width = len(first) - 1, len(scale)
        scaled = values * scale[columns]
        lengths = np.diff(first)
        norms = np.add.reduceat(scaled * scaled, first[:-1]) if n else np.empty(0)
        order = np.arange(n)
        self.spans, self.children, self.radius = [], [], []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(0, n, -1)] if n else []
        while todo:
            a, b, parent = todo.pop()
            rows, node = order[a:b], len(self.spans)
            at = _take(first[rows], lengths[rows])
            cols, vals = columns[at], scaled[at]
            starts = np.cumsum(lengths[rows]) - lengths[rows]
            centroid = np.bincount(cols, weights=vals, minlength=self.width) / (b - a)
            own = norms[rows]

            def apart(point, norm, vals=vals, cols=cols, starts=starts, own=own):
                return own - 2 * np.add.reduceat(vals * point[cols], starts) + norm

            norm = float(centroid @ centroid)
            distances = apart(centroid, norm)
            # The difference of squares loses at most a small share of the squares themselves.
            slack = SLACK * 1e-3 * (float(own.max()) + norm)
            widest = max(float(distances.max()), 0.0)
            self.spans.append((a, b))
            self.children.append([])
            self.radius.append(np.sqrt(widest + slack))
            ids = np.flatnonzero(centroid)
            parts.append((ids, centroid[ids]))
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf and widest > slack:
                one = self._dense(cols, vals, starts, lengths[rows], int(distances.argmax()))
                two = self._dense(cols, vals, starts, lengths[rows], int(apart(one, float(one @ one)).argmax()))
                side = apart(one, float(one @ one)) - apart(two, float(two @ two))
                # Each row goes to the nearer of two far rows; a lopsided cut is moved, so that depth stays bounded.
                middle = int(np.clip((side < 0).sum(), max(1, (b - a) // 16), b - a - max(1, (b - a) // 16)))
                order[a:b] = rows[np.argpartition(side, middle)]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.order = order
        at = _take(first[order], lengths[order]) if n else np.empty(0, dtype=np.int64)
        self.columns, self.values = columns[at], values[at]
        self.first = np.concatenate([[0], np.cumsum(lengths[order])]).astype(np.int64)
        # The centroids by column, so that a query meets its own columns alone.
        node_of = np.repeat(np.arange(len(parts)), [len(ids) for ids, _ in parts])
        ids = np.concatenate([p for p, _ in parts]) if parts else np.empty(0, dtype=np.int64)
        by = np.argsort(ids, kind="stable")
        self._nodes = node_of[by]
        self._means = np.concatenate([v for _, v in parts])[by] if parts else np.empty(0)
        self._starts = np.searchsorted(ids[by], np.arange(self.width + 1))
        self.scale, self.radius = scale, np.array(self.radius)

    def _dense(self, cols, vals, starts, lengths, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        part = slice(starts[row], starts[row] + lengths[row])
        out[cols[part]] = vals[part]
        return out

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node, a number that no score in it exceeds."""
        q = weights / self.scale[columns]
        lengths = self._starts[columns + 1] - self._starts[columns]
        at = _take(self._starts[columns], lengths)
        nodes, q = self._nodes[at], np.repeat(q, lengths)
        dots = np.bincount(nodes, weights=self._means[at] * q, minlength=len(self.radius))
        norms = np.sqrt(np.bincount(nodes, weights=q * q, minlength=len(self.radius)))
        return (dots + norms * self.radius) * (1 + SLACK) + 1e-3

    def search(self, columns: np.ndarray, weights: np.ndarray, best) -> int:
        """Offer scores to ``best`` (``least``: no lower score is wanted; ``offer(rows, scores)``), nodes of the highest bound first.

        Returns the number of rows that were scored.
        """
        if not self.spans or not len(columns):
            return 0
        bounds = self.bounds(columns, weights)
        dense = np.zeros(self.width, dtype=np.int64)
        dense[columns] = weights
        heap, scored = [(-bounds[0], 0)], 0
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < best.least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= best.least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.spans[node]
            low, high = self.first[a], self.first[b]
            scores = np.add.reduceat(self.values[low:high] * dense[self.columns[low:high]], self.first[a:b] - low)
            scored += b - a
            hits = np.flatnonzero(scores >= best.least)
            if len(hits):
                best.offer(self.order[a:b][hits], scores[hits])
        return scored
