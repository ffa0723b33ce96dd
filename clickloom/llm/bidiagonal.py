"""Singular values and right singular vectors of a small square matrix.

Householder reflections make it bidiagonal, differential quotient-difference sweeps with shifts find the singular values
to high relative accuracy, and twisted factorisations at each of them give the vectors.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
# Values closer than this share of the greater one are a cluster, whose vectors are made orthogonal.
CLUSTER = 1e-3


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V) of an upper bidiagonal U' matrix V; both diagonals are not negative."""
    work = np.array(matrix, np.float64)
    size = len(work)
    turn = np.eye(size)
    for k in range(size):
        mirror = _mirror(work[k:, k])
        work[k:, k:] -= np.outer(2 * mirror, mirror @ work[k:, k:])
        if k + 2 < size:
            mirror = _mirror(work[k, k + 1 :])
            work[k:, k + 1 :] -= np.outer(work[k:, k + 1 :] @ mirror, 2 * mirror)
            turn[:, k + 1 :] -= np.outer(turn[:, k + 1 :] @ mirror, 2 * mirror)
    diagonal, upper = np.diagonal(work).copy(), np.diagonal(work, 1).copy()
    # A column of V and the row of U below it change sign together, until nothing is negative.
    sign = 1.0
    for k in range(size - 1):
        row = np.sign(diagonal[k] * sign) or 1.0
        diagonal[k] = abs(diagonal[k])
        step = np.sign(upper[k] * row) or 1.0
        upper[k] = abs(upper[k])
        turn[:, k + 1] *= step
        sign = step
    if size:
        diagonal[-1] = abs(diagonal[-1])
    return diagonal, upper, turn


def _mirror(x: np.ndarray) -> np.ndarray:
    """Unit vector v for which (1 - 2 v v') x lies on the first axis; zero if x does already."""
    v = np.array(x)
    length = np.linalg.norm(v)
    if length == 0 or not np.any(v[1:]):
        return np.zeros_like(v)
    v /= length
    v[0] += 1.0 if v[0] >= 0 else -1.0
    return v / np.linalg.norm(v)


def _sweep(q: np.ndarray, e: np.ndarray, lo: int, hi: int, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One dqds transform of the block lo..hi; None if the shift exceeds the least eigenvalue."""
    new_q, new_e = np.empty(hi - lo + 1), np.empty(hi - lo)
    d = least = q[lo] - shift
    for i in range(hi - lo):
        if d < 0:
            return None
        total = d + e[lo + i]
        ratio = q[lo + i + 1] / total if total > 0 else np.inf
        if not np.isfinite(ratio):
            return None
        new_q[i], new_e[i] = total, e[lo + i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, least


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix without zeros on its diagonal, greatest first."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper]
    tolerance, done = (10 * EPS) ** 2, []
    # Blocks of (q, e, what the shifts took so far), each free of negligible e.
    todo = [(q, e, 0.0)] if q else []
    while todo:
        q, e, taken = todo.pop()
        q, e = np.array(q), np.array(e)
        while len(q):
            small = np.flatnonzero(e <= tolerance * np.minimum(taken + q[1:], taken + q[:-1]))
            if len(small):
                cut = int(small[-1])
                todo.append((q[: cut + 1], e[:cut], taken))
                q, e = q[cut + 1 :], e[cut + 1 :]
            if len(q) == 1:
                done.append(taken + q[0])
                break
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            # The least eigenvalue of the last 2 x 2 part is an upper bound near the end.
            a, b, c = q[-2], e[-1], q[-1]
            half = (a + b + c) / 2
            least = a * c / (half + np.sqrt(max(0.0, half * half - a * c))) if half > 0 else 0.0
            after = None
            for part in (1 - 1e-3 if b > 1e-4 * c else 1 - 4 * b / max(c, a - c, EPS), 0.75, 0.25, 0.0):
                shift = least * max(part, 0.0)
                after = _sweep(q, e, 0, len(q) - 1, shift)
                if after is not None:
                    break
            if after is None:
                raise ArithmeticError("a bidiagonal matrix with a zero on its diagonal")
            q, e, _ = after
            taken += shift
    return np.sort(np.array(done))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of L D L' at ``value``, from the twisted factorisation with the least pivot."""
    n = len(d)
    tiny = np.finfo(np.float64).tiny / EPS
    down, up = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        ratio = d[i] / pivot
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of the ``most`` greatest values, falling.

    Values that are zero within rounding are left out. The entry of greatest size of each vector is positive.
    """
    size = len(matrix)
    if not size or not np.any(matrix):
        return np.zeros(0), np.zeros((size, 0))
    scale = float(np.abs(matrix).max())
    diagonal, upper, turn = bidiagonal(matrix / scale)
    norm = max(diagonal.max(), upper.max(initial=0.0))
    # Zeros become what rounding leaves of them anyway.
    diagonal = np.maximum(diagonal, norm * EPS * 1e-3)
    upper = np.where(upper <= norm * EPS * 1e-3, 0.0, upper)
    # The matrix falls apart where the upper diagonal is zero; each part has its own values and vectors.
    found, start = [], 0
    for end in [*(np.flatnonzero(upper == 0) + 1).tolist(), size]:
        a, b = diagonal[start:end], upper[start : end - 1]
        for value in squared_values(a, b):
            found.append((value, start, end))
        start = end
    found.sort(key=lambda f: (-f[0], f[1]))
    found = [f for f in found if f[0] > (size * EPS) ** 2 * found[0][0]][:most]
    columns: list[np.ndarray] = []
    for i, (value, start, end) in enumerate(found):
        a, b = diagonal[start:end], upper[start : end - 1]
        near = [c for c, f in zip(columns, found) if f[0] - value <= CLUSTER * f[0] and f[1:] == (start, end)]
        z = _twisted(a * a, b / a[:-1], value)
        vector = np.zeros(size)
        vector[start:end] = z
        columns.append(_apart(vector, near, a, b, start, end, value))
    vectors = turn @ np.stack(columns, 1)
    vectors /= np.linalg.norm(vectors, axis=0)
    top = np.abs(vectors).argmax(0)
    vectors *= np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return np.array([f[0] for f in found]) * scale**2, vectors


def _apart(vector, near, a, b, start, end, value):
    """``vector`` made orthogonal to ``near``, or another vector of the cluster if nothing of it is left."""
    if not near:
        return vector
    others = np.stack(near, 1)

    def reject(v):
        for _ in range(2):
            v = v - others @ (others.T @ v)
        return v

    left = reject(vector)
    if np.linalg.norm(left) < 0.5:
        # Inverse iteration from a fixed start, kept away from the vectors that are known.
        block = np.diag(a * a)
        k = np.arange(len(a) - 1)
        block[k + 1, k + 1] += b * b
        block[k, k + 1] = block[k + 1, k] = a[:-1] * b
        # Not quite at the value, so that the matrix stays regular.
        shifted = block - (value + 4 * EPS * float(np.abs(block).max())) * np.eye(len(a))
        left = np.zeros(len(vector))
        left[start:end] = np.cos(1.0 + np.arange(len(a)) * 0.7 * (1 + len(near)))
        left = reject(left)
        for _ in range(4):
            step = np.zeros(len(vector))
            step[start:end] = np.linalg.solve(shifted, left[start:end])
            left = reject(step / np.linalg.norm(step))
            left /= np.linalg.norm(left)
    return left / np.linalg.norm(left)
