"""Suffix order with common-prefix lengths by induced sorting.

Suffixes are induced from the sorted leftmost ones of rising runs, first the falling ones from the left, then the rising ones
from the right. The queue of suffixes yet to be placed has a lane for each character. Every push is larger (from the right:
smaller) than all before it in its lane, so a lane is first in, first out, and what is too much for memory goes to disk.
Each suffix comes with its common prefix with its neighbour; the common prefix of two pushes is one more than the least
between their sources. Order and prefixes count up to a depth, so the reduced string of substring names needs no deeper
recursion than prefix doubling up to that depth.
"""

from __future__ import annotations

import tempfile

import numpy as np

NONE = np.uint8(255)
# Suffixes pushed from in one go, and bytes of queue that stay in memory.
PIECE = 1 << 19
MEMORY = 256 << 20


class Lanes:
    """A queue with a lane for each byte value; lanes are read in order, and what does not fit is kept on disk."""

    def __init__(self, memory: int) -> None:
        self.memory = memory
        self.held = 0
        self.lanes: list[list] = [[] for _ in range(256)]
        self.file = None

    def push(self, lane: int, at: np.ndarray, prefix: np.ndarray) -> None:
        self.held += at.nbytes + prefix.nbytes
        self.lanes[lane].append((at, prefix))
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for lane in self.lanes:
            for i, part in enumerate(lane):
                if not isinstance(part[0], int):
                    place = self.file.tell()
                    self.file.write(part[0].tobytes() + part[1].tobytes())
                    lane[i] = (place, len(part[0]))
        self.held = 0

    def take(self, lane: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """What the lane holds, in large parts; the lane is then empty."""
        parts, self.lanes[lane] = self.lanes[lane], []
        out, small, size = [], [], 0
        for a, b in parts:
            if isinstance(a, int):
                self.file.seek(a)
                raw = self.file.read(b * 5)
                a, b = np.frombuffer(raw[: b * 4], np.int32), np.frombuffer(raw[b * 4 :], np.uint8)
            else:
                self.held -= a.nbytes + b.nbytes
            small.append((a, b))
            size += len(a)
            if size >= PIECE:
                out.append(_joined(small))
                small, size = [], 0
        return out + [_joined(small)] if small else out


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])) if len(parts) > 1 else parts[0]


def _range_min(x: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Least of x[a..z], both ends included, for many ranges."""
    level = np.frexp((z - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), x.dtype)
    width, row, k = 1, x, 0
    most = int(level.max()) if len(level) else -1
    while k <= most:
        on = np.flatnonzero(level == k)
        out[on] = np.minimum(row[a[on]], row[z[on] - width + 1])
        if k < most:
            row = np.minimum(row[:-width], row[width:])
        width, k = width * 2, k + 1
    return out


class _Sorter:
    def __init__(self, data: np.ndarray, depth: int, memory: int) -> None:
        self.t, self.depth, self.memory = data, depth, memory
        n = len(data)
        step = np.zeros(n, np.int8)
        step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
        step[-1] = -1
        at = np.where(step != 0, np.arange(n), n - 1)
        self.rising = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
        left = np.zeros(n, bool)
        left[1:] = self.rising[1:] & ~self.rising[:-1]
        self.left = np.flatnonzero(left).astype(np.int32)
        self.is_left = left

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of pairs of suffixes, up to the depth."""
        out = np.zeros(len(a), np.uint8)
        on, n = np.arange(len(a)), len(self.t)
        for k in range(self.depth):
            x, y = a[on] + k, b[on] + k
            inside = (x < n) & (y < n)
            on, x, y = on[inside], x[inside], y[inside]
            on = on[self.t[x] == self.t[y]]
            if not len(on):
                break
            out[on] += 1
        return out

    def _push(self, lanes: Lanes, run: np.ndarray, at: np.ndarray, prefix: np.ndarray, rising: bool) -> None:
        """Push the predecessors of one kind; ``run`` has the least prefix since each lane's last push (NONE: no push yet)."""
        for k in range(0, len(at), PIECE):
            part, p = at[k : k + PIECE], prefix[k : k + PIECE]
            source = np.flatnonzero((part > 0) & (self.rising[part - 1] == rising))
            pred = part[source] - 1
            lane = self.t[pred]
            order = np.argsort(lane, kind="stable")
            source, pred, lane = source[order], pred[order], lane[order]
            first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]])) if len(lane) else np.zeros(0, np.int64)
            new = np.empty(len(pred), np.uint8)
            if len(pred):
                inner = np.ones(len(pred), bool)
                inner[first] = False
                inner = np.flatnonzero(inner)
                new[inner] = _range_min(p, source[inner - 1] + 1, source[inner])
                new[inner] = np.minimum(new[inner], self.depth - 1) + 1
                upto = np.minimum.accumulate(p)
                since = run[lane[first]]
                new[first] = np.where(since == NONE, 0, np.minimum(np.minimum(since, upto[source[first]]), self.depth - 1) + 1)
            # 254 stands for no element since the last push.
            rest = np.where(run == NONE, NONE, np.minimum(run, p.min()))
            if len(pred):
                last = np.append(first[1:], len(pred)) - 1
                behind = np.append(np.minimum.accumulate(p[::-1])[::-1][1:], np.uint8(254))
                rest[lane[first]] = behind[source[last]]
                for a, z in zip(first.tolist(), np.append(first[1:], len(pred)).tolist()):
                    lanes.push(int(lane[a]), pred[a:z], new[a:z])
            run[:] = rest

    def induce(self, left: np.ndarray, prefix: np.ndarray) -> tuple[list, list]:
        """Falling suffixes of each character in order, and rising ones in reverse, each with prefixes, from sorted ``left``."""
        t, n = self.t, len(self.t)
        cut = np.searchsorted(t[left], np.arange(257))
        lanes, run = Lanes(self.memory), np.full(256, NONE)
        falling = []
        lanes.push(int(t[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.uint8))
        run[t[n - 1]] = 0
        for c in range(256):
            done = []
            while parts := lanes.take(c):
                for at, p in parts:
                    self._push(lanes, run, at, p, False)
                done += parts
            falling.append(done)
            mine, p = left[cut[c] : cut[c + 1]], prefix[cut[c] : cut[c + 1]].copy()
            if len(mine):
                p[0] = self.common(done[-1][0][-1:], mine[:1])[0] if done else 0
                self._push(lanes, run, mine, p, False)
        lanes, run = Lanes(self.memory), np.full(256, NONE)
        rising: list = [None] * 256
        for c in range(255, -1, -1):
            done = []
            while parts := lanes.take(c):
                for at, p in parts:
                    self._push(lanes, run, at, p, True)
                done += parts
            rising[c] = done
            right = done[-1][0][-1:] if done else None
            for at, p in reversed(falling[c]):
                back = np.empty_like(p)
                back[1:] = p[:0:-1]
                back[0] = self.common(at[-1:], right)[0] if right is not None else 0
                right = at[:1]
                self._push(lanes, run, at[::-1], back, True)
        return falling, rising

    def _names(self) -> np.ndarray:
        """Rank of the substring from each of ``left`` to the next one, equal substrings alike."""
        t, left = self.t, self.left
        start = left[np.argsort(t[left], kind="stable")]
        _, rising = self.induce(start, np.zeros(len(start), np.uint8))
        order = [at for c in range(256) for part in reversed(rising[c]) for at in (part[0][::-1],)]
        order = np.concatenate([*order, np.zeros(0, np.int32)])
        order = order[self.is_left[order]]
        number = np.zeros(len(t), np.int32)
        number[left] = np.arange(len(left))
        index = number[order]
        end = np.append(left[1:], len(t))
        size = end[index] - order
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(t), base)]), dtype=np.uint64)
        total = np.zeros(len(t) + 1, np.uint64)
        np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        scale = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(t), inverse)]), dtype=np.uint64)
        stop = np.minimum(order + size + 1, len(t))
        code = (total[stop] - total[order]) * scale[order]
        fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (size[1:] != size[:-1])])[: len(order)]
        names = np.empty(len(left), np.int64)
        names[index] = np.cumsum(fresh)
        return names

    def sorted_left(self) -> np.ndarray:
        """``left`` in suffix order, as far as the depth tells."""
        rank, left, far = self._names(), self.left, 1
        while len(left):
            most = int(rank.max())
            reach = np.append(left[far:], np.full(min(far, len(left)), len(self.t) + self.depth)) - left
            if most == len(left) or (reach[: len(left)] >= self.depth).all():
                break
            later = np.append(rank[far:], np.zeros(min(far, len(rank)), np.int64))[: len(rank)]
            key = rank * (most + 1) + later
            order = np.argsort(key)
            fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            rank = np.empty(len(left), np.int64)
            rank[order] = np.cumsum(fresh)
            far *= 2
        return left[np.argsort(rank, kind="stable")]


def suffixes(data: np.ndarray, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the bytes, sorted by their first ``depth`` bytes, and each one's common prefix with the one before.

    Prefixes count up to the depth, at most 250.
    """
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    s = _Sorter(data, depth, memory)
    left = s.sorted_left()
    prefix = np.zeros(len(left), np.uint8)
    prefix[1:] = s.common(left[:-1], left[1:])
    falling, rising = s.induce(left, prefix)
    order, common = [], []
    for c in range(256):
        end = None
        for at, p in falling[c]:
            order.append(at)
            common.append(p)
            end = at[-1:]
        back = rising[c]
        for k in range(len(back) - 1, -1, -1):
            at, p = back[k]
            order.append(at[::-1])
            up = np.empty_like(p)
            up[1:] = p[:0:-1]
            if end is None:
                up[0] = 0
            elif k == len(back) - 1:
                up[0] = s.common(end, at[-1:])[0]
            else:
                up[0] = back[k + 1][1][0]
            common.append(up)
            end = at[:1]
    return np.concatenate(order), np.concatenate(common)
