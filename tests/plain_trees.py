"""Plain boosting of a few rows, tree by tree and row by row, for the tests of the distributed one."""

from __future__ import annotations

import math

import numpy as np


def bins(x, cuts):
    return np.array([[sum(c < v for c in cuts[f]) for f, v in enumerate(row)] for row in x])


def gradients(kind, y, m, delta):
    if kind == "logistic":
        p = [1 / (1 + math.exp(-v)) for v in m]
        return np.array([a - b for a, b in zip(p, y)]), np.array([a * (1 - a) for a in p])
    return np.clip(np.array(m) - np.array(y), -delta, delta), np.ones(len(y))


def best_split(b, g, h, rows, growth, mask):
    score = lambda s: g[s].sum() ** 2 / (h[s].sum() + growth.l2) if h[s].sum() + growth.l2 > 0 else 0.0
    best = (0.0, None)
    for f in mask:
        for cut in sorted(set(b[rows, f]))[:-1]:
            left, right = rows[b[rows, f] <= cut], rows[b[rows, f] > cut]
            if min(len(left), len(right)) < growth.min_rows or min(h[left].sum(), h[right].sum()) < growth.min_hessian:
                continue
            gain = score(left) + score(right) - score(rows)
            if gain > max(growth.min_gain, best[0] + 1e-9):
                best = (gain, (f, cut, left, right))
    return best


def tree(b, g, h, rows, growth, mask):
    """(splits, leaves): leaves as arrays of rows, splits as features, best first."""
    nodes = [(*best_split(b, g, h, rows, growth, mask), rows, 0)]
    splits = []
    limit = growth.leaves or math.inf
    while len(nodes) < limit:
        able = [k for k, n in enumerate(nodes) if n[1] is not None and n[3] < growth.depth]
        if not able:
            break
        k = max(able, key=lambda k: nodes[k][0])
        _, (f, _, left, right), _, depth = nodes.pop(k)
        splits.append(f)
        nodes += [(*best_split(b, g, h, part, growth, mask), part, depth + 1) for part in (left, right)]
    return splits, [(n[2], n[3]) for n in nodes]


def lower(values, share):
    """The value at rank ceil(share n)."""
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


def boost(b, y, base, rounds, step, growth, kind, masks, inliers=0.9):
    """Margins after each round."""
    margin, out = np.full(len(y), base), []
    for k in range(rounds):
        delta = lower(np.abs(y - margin).tolist(), inliers) if kind == "huber" else math.inf
        g, h = gradients(kind, y, margin, delta)
        features, kept = masks[k]
        _, leaves = tree(b, g, h, np.flatnonzero(kept), growth, features)
        new = margin.copy()
        cells = {}
        for rows, _ in leaves:
            if kind == "huber":
                apart = (y - margin)[rows]
                median = lower(apart.tolist(), 0.5)
                value = median + np.mean(np.sign(apart - median) * np.minimum(np.abs(apart - median), delta))
            else:
                value = -g[rows].sum() / (h[rows].sum() + growth.l2)
            cells.update({tuple(b[r]): step * value for r in rows})
        for r in range(len(y)):
            new[r] += cells[tuple(b[r])] if tuple(b[r]) in cells else math.nan
        margin = new
        out.append(margin)
    return np.array(out)
