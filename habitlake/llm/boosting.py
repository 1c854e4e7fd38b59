"""Gradient-boosted trees over counted cells: small integer features, logistic loss, Newton leaf values.

The training table is already grouped to one row per distinct feature vector with its positive and negative counts, so
its size is bounded by the feature ranges, whatever the corpus. A fitted model becomes a DataFrame expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (feature vector, positives, negatives)
Cell = tuple[tuple[int, ...], float, float]


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@dataclass
class Trees:
    base: float = 0.0
    trees: list = field(default_factory=list)  # a tree is a leaf value or (feature, threshold, low, high)

    def margin(self, x: tuple[int, ...]) -> float:
        total = self.base
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            total += t
        return total

    def score(self, x: tuple[int, ...]) -> float:
        return _sigmoid(self.margin(x))

    def expression(self, features: list[Column]) -> Column:
        def branch(t):
            if not isinstance(t, tuple):
                return F.lit(float(t))
            return F.when(features[t[0]] <= t[1], branch(t[2])).otherwise(branch(t[3]))
        z = F.lit(self.base)
        for t in self.trees:
            z = z + branch(t)
        return 1 / (1 + F.exp(-z))


def boost(cells: list[Cell], rounds: int = 12, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> Trees:
    cells = sorted(cells)
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    model = Trees(math.log((pos + 0.5) / (neg + 0.5)))
    margins = [model.base] * len(cells)

    def grow(rows, left):
        g = sum(r[1] for r in rows)
        h = sum(r[2] for r in rows)
        best = None
        if left:
            for f in range(len(rows[0][0])):
                sums: dict[int, list] = {}
                for x, a, b in rows:
                    s = sums.setdefault(x[f], [0.0, 0.0])
                    s[0] += a
                    s[1] += b
                lg = lh = 0.0
                for v in sorted(sums)[:-1]:
                    lg += sums[v][0]
                    lh += sums[v][1]
                    gain = lg * lg / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g * g / (h + ridge)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, v)
        if not best:
            return rate * g / (h + ridge)
        _, f, v = best
        return f, v, grow([r for r in rows if r[0][f] <= v], left - 1), grow([r for r in rows if r[0][f] > v], left - 1)

    for _ in range(rounds if pos and neg else 0):
        rows = []
        for (x, p, n), z in zip(cells, margins):
            q = _sigmoid(z)
            rows.append((x, p - (p + n) * q, (p + n) * q * (1 - q)))
        tree = grow(rows, depth)
        model.trees.append(tree)
        one = Trees(0.0, [tree])
        margins = [z + one.margin(c[0]) for z, c in zip(margins, cells)]
    return model


def calibrated_threshold(model: Trees, cells: list[Cell], precision: float) -> float:
    """The lowest score from which on at least this share of the (unseen) cells' rows is positive; above 1 if none is."""
    scored = sorted(((model.score(x), p, n) for x, p, n in cells), reverse=True)
    best, pos, neg = 1.1, 0.0, 0.0
    for i, (s, p, n) in enumerate(scored):
        pos, neg = pos + p, neg + n
        last = i + 1 == len(scored) or scored[i + 1][0] < s
        if last and pos > 0 and pos >= precision * (pos + neg):
            best = s
    return best
