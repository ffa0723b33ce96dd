"""Hard negatives by inner product, through a tree of split points with distance ranges.

A node of the tree has up to ``FAN`` split points, and a row belongs to the nearest of them, so that siblings are separated
by hyperplanes. Each split point knows, for every sibling subtree, the range of distances from it to the subtree's rows. A
search window on the score is an annulus around the anchor, since distance^2 = |a|^2 + |x|^2 - 2 score. A subtree is left
out once the range of some split point shows that it has no row in the annulus. What remains are leaves, whose rows are
compared exactly.

The tree is built from a bounded sample; all rows are put into it. Rows are packed into blocks of one leaf, with the ranges
of the block itself. Anchors are broadcast in parts of bounded size and blocks are searched where they lie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import arrow, vectors
from clickloom.session import materialize

# Components become floor(256 c); a window is 30 to 90 hundredths of the positive score.
FACTOR = 256.0
LOW, HIGH = 30, 90
POSITIVES = 5
NEGATIVES = 10
# Split points of a node, rows of the sample that the tree is built from, and bytes of it at most.
FAN = 16
SAMPLE = 16_384
SAMPLE_BYTES = 16 << 20
# Sample rows of a leaf at least, rows of the table it is meant to have at least, and rows and bytes of a block.
LEAF_SAMPLE = 48
BLOCK = 1024
BLOCK_BYTES = 4 << 20
# Bytes of anchors that are broadcast at once, and anchors compared with a block at once.
ANCHOR_BYTES = 16 << 20
TILE = 256
# Doubles hold whole numbers up to here.
EXACT = 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exact: by doubles where these hold them, else by longs."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def norms(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; squares are whole and exact up to where doubles are."""
    a2, b2 = norms(a).astype(np.float64), norms(b).astype(np.float64)
    return np.sqrt(np.maximum(0.0, a2[:, None] + b2[None, :] - 2.0 * products(a, b)))


# The tree.


@dataclass
class Node:
    """Split points, and the child of each: the number of a node, or -1 - the number of a leaf."""

    points: np.ndarray
    children: list[int]
    # (points, points) least and greatest distance from a point to the rows below a child; below, |x|^2 of those rows.
    near: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    far: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    """All nodes, the first is the root, and the path of every leaf: (node, child) from the root on."""

    nodes: list[Node]
    paths: list[list[tuple[int, int]]]
    length: int


def build(sample: np.ndarray, least: int = LEAF_SAMPLE, fan: int = FAN) -> Tree:
    """A tree over the sample; a node of up to ``least`` rows, or of equal rows, is a leaf."""
    nodes: list[Node] = []
    paths: list[list[tuple[int, int]]] = []
    todo: list[tuple[np.ndarray, list[tuple[int, int]]]] = [(sample, [])]
    while todo:
        rows, path = todo.pop()
        points = _split_points(rows, fan) if len(rows) > least else rows[:0]
        if len(points) < 2:
            link = -1 - len(paths)
            paths.append(path)
        else:
            link = len(nodes)
            nodes.append(Node(points, [0] * len(points)))
            owner = distances(rows, points).argmin(1)
            todo += [(rows[owner == j], [*path, (link, j)]) for j in range(len(points))]
        if path:
            nodes[path[-1][0]].children[path[-1][1]] = link
    return Tree(nodes, paths, sample.shape[1])


def _split_points(rows: np.ndarray, fan: int) -> np.ndarray:
    """Rows far apart from each other: each the farthest from those before it, out of an even choice of candidates."""
    candidates = rows[:: max(1, len(rows) // (8 * fan))]
    chosen = [0]
    gap = distances(candidates, candidates[:1])[:, 0]
    while len(chosen) < fan:
        far = int(gap.argmax())
        if gap[far] == 0:
            break
        chosen.append(far)
        gap = np.minimum(gap, distances(candidates, candidates[far : far + 1])[:, 0])
    return candidates[chosen]


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every row: the nearest split point's child, the first of equally near ones, all the way down."""
    if not tree.nodes:
        return np.zeros(len(x), np.int64)
    at = np.zeros(len(x), np.int64)
    while (inner := at >= 0).any():
        for node in np.unique(at[inner]).tolist():
            rows = np.flatnonzero(at == node)
            at[rows] = np.array(tree.nodes[node].children)[distances(x[rows], tree.nodes[node].points).argmin(1)]
    return -1 - at


def with_ranges(tree: Tree, blocks: DataFrame) -> Tree:
    """The tree with the distance ranges of its subtrees, from the ranges of all blocks.

    The driver gets one row for each leaf and split point on its path.
    """
    each = blocks.select("leaf", "least", "most", F.posexplode(F.arrays_zip("near", "far")).alias("i", "r"))
    found = each.groupBy("leaf", "i").agg(F.min("r.near"), F.max("r.far"), F.min("least"), F.max("most")).collect()
    for node in tree.nodes:
        m = len(node.points)
        node.near, node.far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        node.least, node.most = np.full(m, np.inf), np.full(m, -np.inf)
    starts = [np.cumsum([0] + [len(tree.nodes[n].points) for n, _ in path]) for path in tree.paths]
    for leaf, i, near, far, least, most in found:
        step = int(np.searchsorted(starts[leaf], i, "right")) - 1
        number, child = tree.paths[leaf][step]
        node, point = tree.nodes[number], i - int(starts[leaf][step])
        node.near[point, child] = min(node.near[point, child], near)
        node.far[point, child] = max(node.far[point, child], far)
        node.least[child], node.most[child] = min(node.least[child], least), max(node.most[child], most)
    return tree


def outside(own: np.ndarray, near: np.ndarray, far: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Whether no row can lie within ``inner`` and ``outer`` of an anchor, given its distance ``own`` to a point.

    ``near`` and ``far`` bound the distances from the point to the rows. A little slack covers rounding.
    """
    slack = 1e-6 + 1e-9 * (own + far)
    return (near > own + outer + slack) | (far < own - outer - slack) | (far + own < inner - slack)


# Blocks.

BLOCK_SCHEMA = "leaf int, ids binary, labels binary, x binary, near array<double>, far array<double>, least double, most double"


def _to_leaves(batches: Iterable[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for part, x in vectors.blocks(batches, tree.length):
        leaf = pa.array(leaves(tree, x), pa.int32())
        yield pa.RecordBatch.from_arrays([leaf, *part.columns], ["leaf", *part.schema.names])


def _blocks(batches: Iterable[pa.RecordBatch], tree: Tree, most: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = -1, 0

    def flush():
        ids, labels, x = (np.concatenate(c) for c in zip(*held))
        for start in range(0, len(ids), most):
            yield _block(at, ids[start : start + most], labels[start : start + most], x[start : start + most], tree)

    for part, x in vectors.blocks(batches, tree.length):
        leaf = arrow.column(part, "leaf").to_numpy()
        ids, labels = arrow.column(part, "id").to_numpy(), arrow.column(part, "label").to_numpy()
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(leaf)]):
            if held and (leaf[start] != at or n >= most):
                yield from flush()
                held, n = [], 0
            at = int(leaf[start])
            held.append((ids[start:end], labels[start:end], x[start:end]))
            n += end - start
    if held:
        yield from flush()


def _block(leaf: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, tree: Tree) -> pa.RecordBatch:
    near, far = [], []
    for node, _ in tree.paths[leaf]:
        d = distances(x, tree.nodes[node].points)
        near += d.min(0).tolist()
        far += d.max(0).tolist()
    squares = norms(x)
    row = {
        "leaf": leaf, "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(),
        "x": np.ascontiguousarray(x, "<i8").tobytes(), "near": near, "far": far,
        "least": float(squares.min()), "most": float(squares.max()),
    }
    types = [pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2, *[pa.float64()] * 2]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))


# Search.


@dataclass
class Anchors:
    """Anchors of one part, and their windows: per anchor the same number of (lowest, highest score), NaN where none.

    ``same`` says whether partners have the anchor's label or another one.
    """

    numbers: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


class _Best:
    """The k best (score, id) per anchor and window: higher scores first, then lesser ids."""

    def __init__(self, anchors: Anchors):
        shape = (*anchors.low.shape, anchors.k)
        self.score = np.full(shape, np.iinfo(np.int64).min)
        self.id = np.full(shape, np.iinfo(np.int64).max)
        self.n = np.zeros(shape[:2], np.int64)

    def add(self, i: int, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n, k = int(self.n[i, w]), self.score.shape[2]
        if n == k:
            good = scores >= self.score[i, w, -1]
            scores, ids = scores[good], ids[good]
            if not len(scores):
                return
        scores, ids = np.concatenate([self.score[i, w, :n], scores]), np.concatenate([self.id[i, w, :n], ids])
        first = np.lexsort((ids, -scores))[:k]
        m = len(first)
        self.score[i, w, :m], self.id[i, w, :m], self.n[i, w] = scores[first], ids[first], m

    def floor(self, low: np.ndarray) -> np.ndarray:
        """What a score has to reach: the window's low end, or the worst of k rows that are found already."""
        full = self.n == self.score.shape[2]
        return np.where(full, np.maximum(low, self.score[:, :, -1]), low)


def _annuli(a2: np.ndarray, low: np.ndarray, high: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances between which rows with scores of a window lie, for rows with ``least`` <= |x|^2 <= ``most``."""
    inner = np.sqrt(np.maximum(0.0, a2 + least - 2.0 * high))
    outer = np.sqrt(np.maximum(0.0, a2 + most - 2.0 * low))
    # By Cauchy's inequality a window out of reach has no annulus, and NaN none either.
    reach = np.sqrt(a2 * most) * (1 + 1e-9) + 1e-6
    return np.where((low > reach) | (high < -reach) | ~(low <= high), np.inf, inner), outer


def surviving(tree: Tree, anchors: Anchors, low: np.ndarray) -> np.ndarray:
    """(anchors, leaves): whether a leaf may hold a row of some window; siblings fall to the ranges of all split points."""
    alive = np.zeros((len(anchors.ids), len(tree.paths)), bool)
    if not tree.nodes:
        alive[:] = True
        return alive
    a2 = norms(anchors.x).astype(np.float64)[:, None]
    todo = [(0, np.arange(len(anchors.ids)))]
    while todo:
        number, rows = todo.pop()
        node = tree.nodes[number]
        own = distances(anchors.x[rows], node.points)
        for j, child in enumerate(node.children):
            if node.most[j] < 0:
                continue
            inner, outer = _annuli(a2[rows], low[rows], anchors.high[rows], node.least[j], node.most[j])
            shut = ~np.isfinite(inner)
            for i in range(len(node.points)):
                shut |= outside(own[:, i : i + 1], node.near[i, j], node.far[i, j], inner, outer)
            left = rows[~shut.all(1)]
            if not len(left):
                continue
            if child < 0:
                alive[left, -1 - child] = True
            else:
                todo.append((child, left))
    return alive


def _search(batches: Iterable[pa.RecordBatch], tree: Tree, anchors: Anchors, home: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Best rows of a task's blocks. With ``home`` only each anchor's own leaf is searched."""
    best = _Best(anchors)
    alive = surviving(tree, anchors, anchors.low) if home is None else None
    a2 = norms(anchors.x).astype(np.float64)[:, None]
    numbers, ids_out, scores_out, windows = [], [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            leaf = row["leaf"]
            rows = np.flatnonzero(alive[:, leaf] if alive is not None else home == leaf)
            if not len(rows):
                continue
            ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
            x = np.frombuffer(row["x"], "<i8").reshape(len(ids), tree.length)
            for start in range(0, len(rows), TILE):
                _compare(anchors, best, rows[start : start + TILE], tree, row, ids, labels, x, a2)
    for i, w in np.argwhere(best.n > 0).tolist():
        m = int(best.n[i, w])
        numbers += [int(anchors.numbers[i])] * m
        windows += [w] * m
        ids_out += best.id[i, w, :m].tolist()
        scores_out += best.score[i, w, :m].tolist()
    if numbers:
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(windows, pa.int32()), pa.array(ids_out, pa.int64()), pa.array(scores_out, pa.int64())],
            ["anchor", "window", "id", "score"],
        )


def _compare(anchors, best, rows, tree, row, ids, labels, x, a2) -> None:
    low = _Best.floor(best, anchors.low)[rows]
    inner, outer = _annuli(a2[rows], low, anchors.high[rows], row["least"], row["most"])
    shut = ~np.isfinite(inner)
    at = 0
    for node, _ in tree.paths[row["leaf"]]:
        points = tree.nodes[node].points
        own = distances(anchors.x[rows], points)
        for i in range(len(points)):
            shut |= outside(own[:, i : i + 1], row["near"][at + i], row["far"][at + i], inner, outer)
        at += len(points)
    keep = ~shut.all(1)
    rows, low, shut = rows[keep], low[keep], shut[keep]
    if not len(rows):
        return
    scores = products(anchors.x[rows], x)
    fit = (labels[None, :] == anchors.labels[rows, None]) == anchors.same
    fit &= ids[None, :] != anchors.ids[rows, None]
    for r, i in enumerate(rows.tolist()):
        for w in np.flatnonzero(~shut[r]).tolist():
            good = fit[r] & (scores[r] >= low[r, w]) & (scores[r] <= anchors.high[i, w])
            if good.any():
                best.add(i, w, scores[r][good], ids[good])


FOUND = "anchor long, window int, id long, score long"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _nearest(blocks: DataFrame, tree: Tree, anchors: Anchors) -> DataFrame:
    """(anchor, window, place, id, score): the k best rows of every window, out of all blocks.

    A first pass over each anchor's own leaf gives a score that the k-th best row reaches at least.
    """
    context = blocks.sparkSession.sparkContext
    home = context.broadcast((tree, anchors, leaves(tree, anchors.x)))
    first = blocks.mapInArrow(lambda b: _search(b, home.value[0], home.value[1], home.value[2]), FOUND)
    worst = _top(first, anchors.k).groupBy("anchor", "window").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    place = {n: i for i, n in enumerate(anchors.numbers.tolist())}
    low = anchors.low.copy()
    for r in worst.where(F.col("n") == anchors.k).collect():
        i = place[r["anchor"]]
        low[i, r["window"]] = max(low[i, r["window"]], r["score"])
    raised = context.broadcast((tree, Anchors(**{**anchors.__dict__, "low": low})))
    found = blocks.mapInArrow(lambda b: _search(b, raised.value[0], raised.value[1], None), FOUND)
    found = materialize(_top(found, anchors.k), "found")
    home.destroy()
    raised.destroy()
    return found


def mine(
    table: DataFrame, anchor: str = "vec_id % 100 = 0", id_col: str = "vec_id", vector_col: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchor`` and ``label`` are SQL expressions over ``table``. Rows with a null id or label, or a vector that is null, empty
    or holds a null or a number that is not finite, take no part, nor do vectors of another length than most have (the longer of
    equally frequent lengths). An anchor row that is repeated is mined once; other repeated rows count each on their own. Rows
    with the anchor's id are never its partners. An anchor or positive without partners gives no rows; an empty table gives none.
    Ties in score go to the lesser id. Columns with other names are ignored.
    """
    spark = table.sparkSession
    cast = table.select(
        F.col(id_col).cast("long").alias("id"), F.expr(label).cast("long").alias("label"),
        F.coalesce(F.expr(anchor), F.lit(False)).alias("asks"), F.col(vector_col).alias("vector"),
    ).dropna(subset=["id", "label"])
    rows = materialize(vectors.whole(cast, "vector", FACTOR, {"id": "id", "label": "label", "asks": "asks"}), "vectors")
    length = vectors.usual_length(rows)
    rows = rows.where(F.octet_length("x") == 8 * length)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not length:
        return spark.createDataFrame([], schema)
    sample = _sample(rows, length)
    tree = build(sample, max(LEAF_SAMPLE, len(sample) * BLOCK // rows.count()))
    shared = spark.sparkContext.broadcast(tree)
    placed = rows.select("id", "label", "x").mapInArrow(lambda b: _to_leaves(b, shared.value), "leaf int, id long, label long, x binary")
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * length)))
    # Ranges of (leaf, id): a leaf with many rows lies in several tasks.
    dealt = placed.repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id")
    blocks = materialize(dealt.mapInArrow(lambda b: _blocks(b, shared.value, most), BLOCK_SCHEMA), "blocks")
    tree = with_ranges(tree, blocks)

    asked = rows.where("asks").select("id", "label", "x").distinct()
    asked = materialize(asked.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    parts = -(-asked.count() * (8 * length + 400) // ANCHOR_BYTES)
    out = None
    for part in range(parts):
        # A hash deals anchors evenly, so a part exceeds its bytes by little.
        chosen = asked.where(F.pmod(F.xxhash64("anchor"), F.lit(parts)) == part) if parts > 1 else asked
        one = _mine_part(chosen, blocks, tree, positives, negatives)
        out = one if out is None or one is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def _mine_part(chosen: DataFrame, blocks: DataFrame, tree: Tree, positives: int, negatives: int) -> DataFrame | None:
    local = chosen.toArrow().combine_chunks()
    if not local.num_rows:
        return None
    x = vectors.unpack(local.column("x").combine_chunks(), tree.length)
    numbers, ids, labels = (local.column(c).to_numpy() for c in ("anchor", "id", "label"))
    open_end = np.full((len(ids), 1), np.inf)
    near = _nearest(blocks, tree, Anchors(numbers, ids, labels, x, -open_end, open_end, True, positives))
    low, high = np.full((len(ids), positives), np.nan), np.full((len(ids), positives), np.nan)
    place = {n: i for i, n in enumerate(numbers.tolist())}
    pairs = near.select("anchor", "place", "score").toArrow()
    for number, window, score in zip(*(pairs.column(c).to_pylist() for c in ("anchor", "place", "score"))):
        i = place[number]
        # The least and the greatest whole score of the window.
        low[i, window - 1], high[i, window - 1] = -(-LOW * score // 100), HIGH * score // 100
    far = _nearest(blocks, tree, Anchors(numbers, ids, labels, x, low, high, False, negatives))
    left = near.select("anchor", (F.col("place") - 1).cast("int").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    right = far.select("anchor", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    own = chosen.select("anchor", F.col("id").alias("anchor_id"))
    joined = left.join(right, ["anchor", "window"]).join(own, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _sample(rows: DataFrame, length: int) -> np.ndarray:
    """At most ``SAMPLE`` different vectors in the order of a hash of their rows."""
    most = max(FAN, min(SAMPLE, SAMPLE_BYTES // (8 * length)))
    taken = rows.select("x", F.xxhash64("id", "x").alias("code")).orderBy("code", "x").limit(most).toArrow().column("x").combine_chunks()
    return np.unique(vectors.unpack(taken, length), axis=0)
