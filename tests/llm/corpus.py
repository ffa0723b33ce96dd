"""Small tables with every odd case, for the tests of the corpus operators."""

from __future__ import annotations

import random

SYLLABLES = "the ing er and ion ou th an re he at en on ti es or".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def text(rng, n):
    return " ".join(word(rng) for _ in range(n))


def odd_texts(rng):
    """Null, empty, blank, tiny, accented, unusual and very long texts."""
    return [
        None, "", " \n\t", "a", "Ä", "😀 é́", "12 34", "...", "\x00\x1f\x7f", "one two three four", "One two THREE four",
        "one two three four five", "É è x", "<|endoftext|> it's", text(rng, 30_000), "x" * 70_000, "ab " * 20_000,
    ]


def near_duplicates(rng, groups=12):
    """Texts with exact copies, near copies of different closeness, and a passage that many share."""
    passage = text(rng, 40)
    out = []
    for _ in range(groups):
        base = [word(rng) for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = word(rng)
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                out.append(out[-1])
    for _ in range(15):
        out.append(text(rng, rng.randint(5, 60)) + " " + passage + " " + text(rng, rng.randint(5, 60)))
    return out


def documents(spark, seed=1, extra=()):
    """doc_id, text and other columns, some with names the operators use themselves; with repeated rows."""
    rng = random.Random(seed)
    texts = odd_texts(rng) + near_duplicates(rng) + list(extra)
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    lines = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), 0, "x", 1, [1], None) for i, t in rows]
    lines.append(lines[5])
    names = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, spans array<int>, node string"
    return spark.createDataFrame(lines, names), [(r[0], r[1]) for r in lines]
