"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from fractions import Fraction

import numpy as np

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text: str | None) -> list[bytes]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)]


def decontaminate(docs, items, window=10):
    grams: dict[tuple, set[str]] = {}
    for item, text in items:
        w = bench_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def shingle_set(text, n=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard_classes(docs):
    sets = [shingle_set(t) for _, t in docs]
    where: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                top[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs)]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in spans)


def nearest(rows, queries, k):
    out = []
    for q, code in queries:
        order = sorted((bin((code ^ c) & (1 << 64) - 1).count("1"), i) for i, c in rows if i != q)
        out += [(q, p + 1, i, d) for p, (d, i) in enumerate(order[:k])]
    return sorted(out)


def license_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def licenses(docs, templates, size=5):
    """Documents of which some window of the template's class reaches the containment."""
    out = []
    for doc, text in docs:
        w = license_words(text)
        grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        for t in templates:
            length = (1 << t.size) + (1 << (t.size - 1)) - size + 1
            step = 1 << (t.size - 1)
            share = [len(t.shingles & set(grams[i : i + length])) / len(t.shingles) for i in range(0, len(grams), step)]
            if share and max(share) >= 0.75:
                out.append((doc, t.name, max(share), next(i * step for i, s in enumerate(share) if s >= 0.75)))
    return sorted(out)


def repeats(docs, n=50):
    """(id, bytes, removed, spans, sha256 of the rest): bytes covered by n bytes that start in a document with a lesser id too."""
    least: dict[bytes, int] = {}
    raw = [(doc, (text or "").encode()) for doc, text in docs]
    for doc, b in raw:
        for i in range(len(b) - n + 1):
            g = b[i : i + n]
            least[g] = min(least.get(g, doc), doc)
    out = []
    for doc, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < doc:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def grams(text):
    """Three-byte grams: ASCII letters in lower case, all other ASCII as blanks, blanks merged."""
    raw = bytes(c if c >= 128 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in (text or "").encode())
    raw = re.sub(rb" +", b" ", raw)
    return [raw[i : i + 3] for i in range(len(raw) - 2)]


def gram_bin(g):
    return ((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 & 0xFFFFFFFF) >> 16


def language_model(labelled):
    count: dict[str, dict[int, int]] = {}
    for text, lang in labelled:
        if text is not None and lang is not None:
            c = count.setdefault(lang, {})
            for g in grams(text):
                c[gram_bin(g)] = c.get(gram_bin(g), 0) + 1
    total = {k: sum(c.values()) + 0.5 * 65536 for k, c in count.items()}
    return {k: (lambda b, c=c, t=total[k]: (c.get(b, 0) + 0.5) / t) for k, c in sorted(count.items())}


def languages(text, model):
    """Shares by expectation-maximisation over the language set with the best penalised likelihood."""
    if not model or not re.search(r"[^\W\d_]", text or ""):
        return {}
    n: dict[int, int] = {}
    for g in grams(text):
        n[gram_bin(g)] = n.get(gram_bin(g), 0) + 1
    if not n:
        return {}
    p = {b: {k: f(b) for k, f in model.items()} for b in n}

    def em(names):
        share = {k: 1 / len(names) for k in names}
        for _ in range(12):
            new = dict.fromkeys(names, 0.0)
            for b, m in n.items():
                whole = sum(share[k] * p[b][k] for k in names)
                for k in names:
                    new[k] += m * share[k] * p[b][k] / whole
            share = {k: v / sum(n.values()) for k, v in new.items()}
        return share, sum(m * math.log(sum(share[k] * p[b][k] for k in names)) for b, m in n.items())

    every = em(list(model))[0]
    order = sorted(model, key=lambda k: -every[k])
    best = max(({k: 1.0} for k in model), key=lambda s: em(list(s))[1])
    value = em(list(best))[1] / 3
    cost = 2.0 * math.log(max(sum(n.values()) / 3, 2))
    for many in range(2, len(order) + 1):
        share, log = em(order[:many])
        if log / 3 - cost * (many - 1) <= value:
            break
        best, value = share, log / 3 - cost * (many - 1)
    return best


RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def all_spans(text, table, symbols=96, threshold=10.0):
    base = base_spans(text)
    more = []
    for m in RUN.finditer(text or ""):
        s = m[0]
        score = sum(table[(ord(a) - 32) * symbols + ord(b) - 32] for a, b in zip(s, s[1:]))
        free = all(m.end() <= a or z <= m.start() for a, _, z, _ in base)
        if free and re.search("[0-9]", s) and re.search("[A-Za-z]", s) and score >= threshold:
            more.append((m.start(), 3, m.end(), "random"))
    return sorted(base + more)


def mixed(docs, seed="mix"):
    """(id, source, size, source_size, target, taken) under weights 1, 2, 3 and at most three repetitions."""
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, _ in docs}
    sizes: dict = {}
    for i, _, s in docs:
        sizes[s] = sizes.get(s, 0) + size[i]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    rest, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        full = {s for s in open_ if 3 * sizes[s] < weight[s] * rest / sum(weight[x] for x in open_)}
        if not full:
            w = sum(weight[x] for x in open_)
            target |= {s: weight[s] * rest / w for s in open_}
            break
        target |= {s: float(3 * sizes[s]) for s in full}
        rest -= sum(3 * sizes[s] for s in full)
        open_ -= full
    out = []
    for s in names:
        rounds, left = divmod(int(target[s] + 0.5), sizes[s]) if sizes[s] else (0, 0)
        mine = sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for i, _, x in docs if x == s)
        for _, i in mine:
            more = max(0, min(size[i], left))
            left -= size[i]
            out.append((i, s, size[i], sizes[s], target[s], rounds * size[i] + more))
    return sorted(out)


def whole_vectors(table, factor):
    """(id, floor(factor * component)) of the rows whose vector is whole and as long as most."""
    rows = [(i, v) for i, v in table if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(factor * c) for c in v]) for i, v in rows]


def check_whitened(got, table, most=16):
    """Rows of the whitening against the eigenvectors of the covariance; signs may differ by component."""
    rows = whole_vectors(table, 64.0)
    distinct = np.array(sorted({tuple(x) for _, x in rows}), np.int64) + 1_000_000
    n, sums = len(distinct), [int(s) for s in distinct.sum(0)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array([[float(Fraction(int(c) * n - s, n)) for c, s in zip(x, sums)] for x in distinct])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    kept = [k for k in np.argsort(-values) if values[k] > 1e-9 * max(values.max(), 1e-300)][:most]
    want = sorted((i, sum((n * (c + 1_000_000) - s) ** 2 for c, s in zip(x, sums)), x) for i, x in rows)
    assert len(got) == len(want) * len(kept)
    trace = np.trace(covariance)
    for number, k in enumerate(kept, 1):
        mine = sorted((r for r in got if r[1] == number), key=lambda r: (r[0], r[3]))
        projected = np.array([(np.array(x) + 1_000_000 - mean) @ axes[:, k] / np.sqrt(values[k]) for _, _, x in want])
        whitened = np.array([r[4] for r in mine])
        assert [(r[0], r[2], r[3]) for r in mine] == [(i, n, d) for i, d, _ in want]
        assert np.allclose(whitened * np.sign(whitened @ projected), projected, rtol=1e-6, atol=1e-6)
        assert all(abs(r[5] - values[k] / trace) < 1e-6 * r[5] and r[6] < 1e-4 for r in mine)


def hard_negatives(table):
    """Rows (id, label, vector) against all others."""
    labels = {k: lab for k, (_, lab, _) in enumerate(table)}
    rows = [(i, labels[k], v) for k, (i, _, v) in enumerate(table) if i is not None and labels[k] is not None]
    rows = [(i, lab, [math.floor(256.0 * c) for c in v]) for i, lab, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, x in {(i, lab, tuple(v)) for i, lab, v in rows if i % 100 == 0}:
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, lab) for i, lab, y in rows if i != a)
        for s, i, _ in [t for t in scored if t[2] == label][:5]:
            fit = [(t, j) for t, j, lab in scored if lab != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j) in enumerate(fit, 1)]
    return sorted(out)
