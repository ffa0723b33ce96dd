"""Whitening, web archives and hard negatives on small tables with every odd case."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import bidiagonal, negatives, warc, whitening


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def vectors(spark, lines, extra=""):
    return spark.createDataFrame(lines, f"vec_id long, embedding array<double>, label int{extra}")


ODD = [None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]


# Whitening.


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_singular_values_and_vectors(size):
    rng = np.random.default_rng(size)
    turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
    for values in [rng.random(size), np.logspace(0, -7, size), np.ones(size), 1 + 1e-10 * np.arange(size), np.arange(size) // 2.0]:
        matrix = np.linalg.qr(rng.normal(size=(3 * size, size)) @ np.diag(values) @ turn, mode="r")
        want = np.linalg.svd(matrix)[1] ** 2
        got, axes = bidiagonal.right_vectors(matrix, size)
        assert len(got) >= (want > 1e-12 * want[0]).sum() * (want[0] > 0)
        assert np.allclose(got, want[: len(got)], rtol=1e-9, atol=1e-25)
        assert np.allclose(axes.T @ axes, np.eye(len(got)), atol=1e-10)
        assert np.allclose(matrix.T @ (matrix @ axes), axes * got, atol=1e-11 * max(1, want[0]))


def test_small_singular_values_are_relatively_exact():
    """Squared values of a bidiagonal matrix over 12 orders, where the eigenvalues of its square lose all digits."""
    diagonal, upper = np.logspace(0, -6, 12), np.logspace(-1, -7, 11)
    want = np.linalg.svd(np.diag(diagonal) + np.diag(upper, 1))[1][:-1] ** 2
    assert np.allclose(bidiagonal.squared_values(diagonal, upper)[:-1], want, rtol=1e-9)


def test_whitening_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    good = [[rng.gauss(0, 1) + 100, rng.gauss(0, 5), rng.random()] for _ in range(150)]
    good += [good[3]] * 60 + [[c + 1e-6 for c in good[4]]]
    lines = [(i, v, 1, 0, [1.0], 2.0) for i, v in enumerate(good + ODD)]
    lines += [(7, good[7], None, 0, None, None), (7, good[8], 1, 0, None, None)]
    df = vectors(spark, lines, ", component int, x array<double>, whitened double").repartition(20)
    plain = [(r[0], r[1]) for r in lines if r[1] is None or len(r[1]) != 2]
    got = whitening.whiten_table(df)
    assert got.columns == "vec_id component n deviation whitened explained identity_error".split()
    brute.check_whitened([tuple(r) for r in got.collect()], plain)
    # Triangles of many tasks go through several rounds, blocks are of a few rows, and nothing changes.
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening.vectors, "STEP_BYTES", 100)
    brute.check_whitened([tuple(r) for r in whitening.whiten_table(df).collect()], plain)
    null_id = vectors(spark, [(None, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [2.0, 2.0], 1)])
    assert whitening.whiten_table(null_id).where("vec_id IS NULL").count() == 2


def test_whitening_without_variance(spark):
    for lines in [[], [(1, None, 1)], [(1, [2.0, 3.0], 1)], [(1, [2.0, 3.0], 1), (2, [2.0, 3.0], 1)]]:
        assert whitening.whiten_table(vectors(spark, lines)).count() == 0
    # One direction only, however many components there are.
    line = whitening.whiten_table(vectors(spark, [(i, [float(i), 2.0 * i, 5.0], 1) for i in range(9)]))
    assert {r.component for r in line.collect()} == {1}
    assert line.agg(F.max(F.abs(F.col("explained") - 1))).first()[0] < 1e-12


def test_deviation_is_exact_beyond_doubles(spark):
    got = whitening.whiten_table(vectors(spark, [(1, [4e6, 0.0], 1), (2, [-1e6, 1.0], 1), (3, [0.0, 2.0], 1)])).where("component = 1")
    x = np.array([[256_000_000, 0], [-64_000_000, 64], [0, 128]], object)
    want = ((3 * x - x.sum(0)) ** 2).sum(1).tolist()
    assert [r.deviation for r in got.orderBy("vec_id").collect()] == want


# Web archives.


HTML = [
    None, "", "a", "a", "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "\r\n", "\n\n\n", "é 😀 \u2028 \x85 \x00", "x" * 300_000, "line\n" * 5000,
    "x" * 300_000, "HTTP/1.1 200 OK\r\n\r\nWARC/1.1",
]
URLS = [
    None, "", "http://www.Example.com:80/a b?c=1", "https://sub.example.com/", "not a url", "http://[bad", "http://x.org/\r\nWARC-Type: x",
    "https://example.com:8443/p", "http://example.com:99999999/", "//é.example/ü", "http://x.org/%0D", "mailto:a@b.c",
]


def pages(spark):
    lines = [(i, URLS[i % len(URLS)], h, 5, "z", None) for i, h in enumerate(HTML * 3)]
    lines += [lines[8], (None, URLS[3], "a", 5, None, None), (None, None, "only", 1, None, None), (-4, URLS[3], "neg", 1, None, None)]
    return spark.createDataFrame(lines, "page_id long, url string, html string, run int, place string, captured string"), lines


def plain_records(lines, least=0):
    first = {}
    for i, _, html, *_ in sorted(lines, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    out = []
    for i, _, html, *_ in lines:
        data = (html or "").encode()
        own = first[html or ""] == i or len(data) < least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if own else "revisit", None if own else first[html or ""]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 2])
def test_archives_round_trip(spark, monkeypatch, least):
    df, lines = pages(spark)
    # Runs of three entries and merges that hold two.
    monkeypatch.setattr(warc, "RUN_ENTRIES", 3)
    monkeypatch.setattr(warc, "PIECE", 2)
    merged = warc.archive_table(df.repartition(5), least)
    assert rows(merged, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == plain_records(lines, least)
    ordered = [(r.url_key, r.captured, r.page_id) for r in merged.orderBy("shard", "place").collect()]
    assert ordered == sorted(ordered, key=warc.order)
    assert warc.archive_table(df.limit(0)).count() == 0


def test_archives_are_plain_records(spark, tmp_path):
    """The files read as WARC without Spark: versions, headers and lengths, each response with its payload."""
    df, lines = pages(spark)
    path = str(tmp_path / "archives")
    warc.write_archives(warc.captures(df), path)
    payloads, types = [], []
    for file in Path(path).glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            names = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            block, data = rest[: int(names[b"Content-Length"])], rest[int(names[b"Content-Length"]) :]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            types.append(names[b"WARC-Type"])
            if types[-1] == b"response":
                payloads.append(block.partition(b"\r\n\r\n")[2].decode())
    want = plain_records(lines)
    assert len(types) == len(lines) and types.count(b"revisit") == sum(r[3] == "revisit" for r in want)
    assert sorted(set(payloads)) == sorted({r[2] or "" for r in lines})


def test_damaged_archives_are_errors(spark, tmp_path):
    path = str(tmp_path / "archives")
    spark.createDataFrame([("WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n",)], "value string").write.text(path)
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_runs(spark, path).collect()


def test_loser_tree():
    rng = random.Random(5)
    for size in range(12):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.choice([0, 1, 7, 30]))) for _ in range(size)]
        marked = [[(x, i, k) for k, x in enumerate(run)] for i, run in enumerate(runs)]
        got = list(warc.LoserTree([iter(r) for r in marked], lambda t: t[0]))
        # Equal keys come run by run, each in its order.
        assert got == sorted(t for run in marked for t in run)


def test_url_keys():
    keys = [warc.url_key(u) for u in URLS]
    assert keys[:5] == ["", "", "com,example)/a b?c=1", "com,example,sub)/", "not a url"]
    assert warc.url_key("https://example.com:8443/p") == "com,example:8443)/p"


# Hard negatives.


def labelled(spark, seed, n=900, hot=300):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    lines = []
    for i in range(n):
        c = rng.randrange(8)
        lines.append((rng.choice([i, i, i, i - 1]), [rng.gauss(m, 0.3) for m in centres[c]], rng.choice([c % 4, c % 4, None]), 9, [1.0], "s"))
    lines += [(n + i, centres[0], i % 3, 9, None, None) for i in range(hot)]
    lines += [(2 * n + 100 * i, v, 1, 9, None, None) for i, v in enumerate([*ODD, [0.0] * 6])]
    lines += [lines[0], (None, centres[1], 1, 9, None, None)]
    df = vectors(spark, lines, ", id int, x array<double>, score string")
    return df, [(r[0], r[2], r[1]) for r in lines if not (r[1] is not None and len(r[1]) == 2)]


def test_hard_negatives_equal_plain_version(spark, monkeypatch):
    df, plain = labelled(spark, 1)
    want = brute.hard_negatives(plain)
    assert len(want) > 200
    assert rows(negatives.mine(df)) == sorted(want, key=repr)
    # A deep tree of small blocks, anchors in several parts and tiles.
    for name, value in {"LEAF_SAMPLE": 5, "BLOCK": 8, "FAN": 4, "ANCHOR_BYTES": 2000, "TILE": 2}.items():
        monkeypatch.setattr(negatives, name, value)
    assert rows(negatives.mine(df.repartition(7))) == sorted(want, key=repr)


def test_hard_negatives_of_little(spark):
    for lines in [[], [(100, None, 1)], [(100, [1.0, 0.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)], [(None, [1.0], 1)]]:
        assert negatives.mine(vectors(spark, lines)).count() == 0
    one = negatives.mine(vectors(spark, [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (3, [0.9, 0.0], 2), (2, [0.9, 5.0], 2), (4, [0.91, 0.0], 2)]))
    assert rows(one) == [(100, 1, 1, 2, 65536, 58880), (100, 1, 2, 3, 65536, 58880)]


def test_ranges_leave_out_subtrees():
    """Windows open a small part of a clustered table's leaves, and never leave out a leaf that has a row."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 8)).repeat(100, 0) * 1000 + rng.normal(size=(4000, 8)) * 10).astype(np.int64)
    tree = negatives.build(x, 60)
    owner = negatives.leaves(tree, x)
    for node in tree.nodes:
        m = len(node.points)
        node.near, node.far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        node.least, node.most = np.full(m, np.inf), np.full(m, -np.inf)
    for leaf, path in enumerate(tree.paths):
        mine = x[owner == leaf]
        for number, child in path if len(mine) else []:
            node, d = tree.nodes[number], negatives.distances(mine, tree.nodes[number].points)
            node.near[:, child], node.far[:, child] = np.minimum(node.near[:, child], d.min(0)), np.maximum(node.far[:, child], d.max(0))
            squares = negatives.norms(mine)
            node.least[child], node.most[child] = min(node.least[child], squares.min()), max(node.most[child], squares.max())
    asked = x[::200]
    own = negatives.norms(asked).astype(float)[:, None]
    n = len(asked)
    anchors = negatives.Anchors(np.arange(n), np.arange(n), np.zeros(n, np.int64), asked, 0.95 * own, own, True, 5)
    alive = negatives.surviving(tree, anchors, anchors.low)
    scores = asked @ x.T
    has = np.zeros_like(alive)
    for i, j in np.argwhere((scores >= anchors.low) & (scores <= anchors.high)):
        has[i, owner[j]] = True
    assert (alive | ~has).all()
    assert alive.mean() < 0.4
