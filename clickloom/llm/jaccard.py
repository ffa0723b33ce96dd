"""N-gram Jaccard join by a token-group matrix, for classes of near-duplicate documents.

Documents with the same shingle set are one node. Nodes are compared with likely neighbours first (the first node with the
same least hash, the most central nodes of a token); what is linked so forms a group. The matrix holds the tokens of each
group's members: of a set of n, sorted by one global order, the first n - ceil(t n) + l tokens, of which two sets of
similarity t share at least l. A node's tokens met in a group bound its overlap with any member; a group that reaches the
bound is opened and its members are compared exactly. Members of one group are never compared again, so a large group of
copies costs a few comparisons for each member. Likely neighbours and the order of tokens (frequent ones last, so that a
common passage does not bring unlike documents together) are heuristics that only save work: the last stage opens every
group that the bound does not close.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import arrow
from clickloom.llm.components import components
from clickloom.llm.words import VISIBLE, mix, shingles, words
from clickloom.session import materialize

SHINGLE = 5
PERCENT = 75
# Tokens that two similar sets share at least in the matrix (fewer where the sets are smaller).
SHARED = 16
# Least hashes of a node; by so many of them it looks for a first neighbour, of which so many must agree.
SEEDS = 8
LOOKED_UP = 3
AGREED = 4
# Most central nodes of a token that its other nodes are compared with.
CENTRAL = 3
# Members of a block, and links of a node from which it has blocks apart.
BLOCK = 256
# A token in this many sets of one stretch of STRETCH tokens is reported as frequent.
OFTEN = 3
STRETCH = 4_000_000
# Frequent tokens that order the matrix, at most; a bound of the broadcast, not of the result.
MOST_FREQUENT = 1_000_000
# Bits of the broadcast filter that saves shuffling texts no pair needs (2^26 bits are 8 MB).
FILTER_BITS = 26
MINUS = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Sets:
    """Sorted shingle hashes of some texts with the node (fingerprint of the set) of each; no node where there is no word."""

    tokens: list[np.ndarray]
    node: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, n: int = SHINGLE) -> Sets:
        tokens = list(shingles(words(*arrow.raw(column), VISIBLE), n))
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = mix(np.concatenate([*tokens, np.zeros(0, np.uint64)]) + MINUS)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat, dtype=np.uint64)])
        ends = np.cumsum(size)
        node = mix(total[ends] - total[ends - size] + size.astype(np.uint64) * MINUS)
        return cls(tokens, node.astype(np.int64))

    def nodes(self) -> pa.Array:
        return pa.array(self.node, mask=np.fromiter((len(t) == 0 for t in self.tokens), bool, len(self.tokens)))


def _least(tokens: np.ndarray) -> list[int]:
    """The least value of the set under each seed's order."""
    return [int(mix(tokens ^ np.uint64(s * 0x2545F4914F6CDD1D & (1 << 64) - 1)).min().astype(np.int64)) for s in range(1, SEEDS + 1)]


def _summaries(docs: DataFrame, n: int) -> DataFrame:
    """Of every row id, node, size and least values; besides, frequent tokens (no id) with counts.

    Both come from one reading of the texts. A set is counted once in a stretch.
    """
    kind = docs.schema["id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def frequent() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            token, count = token[count >= OFTEN].astype(np.int64), count[count >= OFTEN]
            held.clear()
            seen.clear()
            k = len(token)
            nothing = [pa.nulls(k, id_type[0]), pa.nulls(k, pa.int64()), pa.array(count), pa.nulls(k, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(token)], names)

        names, id_type = ["id", "node", "n", "least", "token"], [pa.null()]
        size = 0
        for step in arrow.steps(batches, "text"):
            id_type[0] = step.column(0).type
            sets = Sets.of(step.column(1), n)
            least = [_least(t) if len(t) else [] for t in sets.tokens]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), sets.nodes(), pa.array(map(len, sets.tokens), pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.nulls(step.num_rows, pa.int64())],
                names,
            )
            for node, t in zip(sets.node.tolist(), sets.tokens):
                if node not in seen:
                    seen.add(node)
                    held.append(t)
                    size += len(t)
            if size >= STRETCH:
                yield frequent()
                size = 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, f"id {kind.simpleString()}, node long, n long, least array<long>, token long")


def _order(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, with their class: the logarithm of their count."""
    rows = summaries.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    table = rows.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    token, n = table.column("token").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    at = np.argsort(token)
    return token[at], np.log2(np.maximum(n[at], 1)).astype(np.uint8) + np.uint8(1)


def _head(tokens: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The tokens of a set that enter the matrix."""
    n = len(tokens)
    least = -(-PERCENT * n // 100)
    many = n - least + min(SHARED, least)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        rank = np.where(frequent[at] == tokens, classes[at], 0)
        tokens = tokens[np.argsort(rank, kind="stable")]  # within a class by value
    return tokens[:many]


def _matrix_tokens(docs: DataFrame, n: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, node) of the matrix; tokens of a single node left out."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for step in arrow.steps(batches, "text"):
            sets = Sets.of(step.column(1), n)
            token, node = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for name, t in zip(sets.node.tolist(), sets.tokens):
                if len(t) and name not in seen:
                    seen.add(name)
                    token.append(_head(t, *shared.value))
                    node.append(np.full(len(token[-1]), name))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).astype(np.int64)), pa.array(np.concatenate(node))], ["token", "node"])

    def several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of tokens with more than one node, from rows sorted by token and node; one row is carried over."""
        carry, given = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            token, node = (np.asarray(c) for c in batch.columns)
            if carry is not None:
                token, node = np.concatenate([carry[0], token]), np.concatenate([carry[1], node])
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
            token, node = token[fresh], node[fresh]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            many = size > 1
            many[0] |= given
            out = np.repeat(many, size)
            out[0] &= not given
            carry, given = (token[-1:], node[-1:]), bool(many[-1])
            yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(node[out])], ["token", "node"])

    rows = docs.mapInArrow(emit, "token long, node long").repartition("token").sortWithinPartitions("token", "node")
    return rows.mapInArrow(several, "token long, node long")


def _texts(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, text), one row for each of the given nodes.

    A bitmap of bounded size, broadcast, spares the shuffle most texts that are not asked for; the join decides.
    """
    at = F.shiftrightunsigned("node", 64 - FILTER_BITS) + 1  # the bitmap functions count from 1
    bits = nodes.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    wanted = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for b, chunk in bits.collect():
        begin = (b - 1) * len(chunk)
        wanted[begin : begin + len(chunk)] |= np.frombuffer(bytes(chunk), np.uint8)[: len(wanted) - begin]
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for step in arrow.steps(batches, "text"):
            sets = Sets.of(step.column(1), n)
            place = (sets.node.astype(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hit = (shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            keep = []
            for name, h, t in zip(sets.node.tolist(), hit.tolist(), sets.tokens):
                keep.append(bool(h) and len(t) > 0 and name not in seen)
                if keep[-1]:
                    seen.add(name)
            keep = pa.array(keep, pa.bool_())
            node, text = pa.array(sets.node).filter(keep), arrow.texts(step.column(1)).filter(keep).cast(pa.string())
            yield pa.RecordBatch.from_arrays([node, text], ["node", "text"])

    found = docs.mapInArrow(emit, "node long, text string").join(nodes, "node", "left_semi")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _linked(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the similarity, compared exactly."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Both texts of a row are read: half a step each.
            for step in arrow.steps([batch], "ta", arrow.STEP_BYTES // 2):
                for part in arrow.steps([step], "tb", arrow.STEP_BYTES // 2):
                    a, b = Sets.of(arrow.column(part, "ta"), n).tokens, Sets.of(arrow.column(part, "tb"), n).tokens
                    keep = []
                    for x, y in zip(a, b):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
                    yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    texts = materialize(_texts(docs, nodes, n), "texts")
    a = texts.withColumnsRenamed({"node": "u", "text": "ta"})
    b = texts.withColumnsRenamed({"node": "v", "text": "tb"})
    return pairs.join(a, "u").join(b, "v").select("u", "v", "ta", "tb").mapInArrow(compare, "u long, v long")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the group of each node; a node without a link is a group of its own."""
    if labels is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """id, n_shingles and component_id (least id reachable over links) of every row.

    Words are runs without white space, A-Z in lower case; a set holds the distinct n-word shingles, the whole sequence
    if there are fewer words. Two documents link at a similarity of 75 hundredths or more. Shingles and sets are compared
    by 64-bit hashes. Null and empty texts have no shingles and no links: their class is their own id. Rows with the same
    id are judged apart, each by its own text; a null id never names a class that has another. Other columns are
    ignored; an empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with arrow.small_batches(docs.sparkSession):
        summaries = materialize(_summaries(docs, n), "summaries")
        rows = summaries.where("token IS NULL")
        nodes = materialize(
            rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("least").alias("least")),
            "nodes",
        )
        links = materialize(_linked(docs, _stars(nodes), n), "links")
        labels = components(links)
        matrix = materialize(_matrix_tokens(docs, n, _order(summaries)), "matrix")
        met = _active(_labelled(matrix, labels), nodes)
        near = materialize(_central(met), "central")
        pairs = near.where("root <> other").select("u", "v")
        links = materialize(links.unionByName(_linked(docs, _likely(pairs, nodes), n)), "links")
        labels = components(links)
        met = _active(_labelled(matrix, labels), nodes)
        links = links.unionByName(_opened(docs, met, nodes, labels, _groups(near, nodes), n))
        labels = components(links)

    named = _labelled(nodes.select("node", "id"), labels)
    ids = named.groupBy("root").agg(F.min("id").alias("component_id"))
    names = named.select("node", "root").join(ids, "root").select("node", "component_id")
    out = rows.join(names, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _stars(nodes: DataFrame) -> DataFrame:
    """Each node with the first node of the same least hash, for some seeds."""
    each = nodes.select("node", F.posexplode(F.slice("least", 1, LOOKED_UP)).alias("seed", "value"))
    first = each.groupBy("seed", "value").agg(F.min("node").alias("u"), F.count("*").alias("many")).where("many > 1")
    pairs = each.join(first, ["seed", "value"]).where("node <> u").select("u", F.col("node").alias("v")).distinct()
    return _likely(pairs, nodes)


def _sized(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes alone allow the similarity, with both nodes' least hashes."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("least").alias(f"l{x}")) for x in ("u", "v"))
    both = pairs.join(a, "u").join(b, "v")
    return both.where(100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv"))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of which enough least hashes agree."""
    agreed = F.size(F.filter(F.zip_with("lu", "lv", lambda x, y: x == y), lambda e: e))
    return _sized(pairs, nodes).where(agreed >= AGREED).select("u", "v")


def _need(n: Column) -> Column:
    """Tokens of the matrix that a set of n shares at least with any similar set, which may be smaller."""
    return F.least(F.lit(SHARED), F.ceil(F.ceil(n * PERCENT / 100) * PERCENT / 100))


def _active(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (token, node, root, shared) of tokens in several groups and of nodes that have enough of them for any link."""
    sizes = nodes.select("node", _need(F.col("n")).alias("need"))
    met = met.select("token", "node", "root")
    for _ in range(2):
        several = met.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("token")
        met = met.join(several, "token", "left_semi")
        enough = met.groupBy("node").agg(F.count("*").alias("shared")).join(sizes, "node").where("shared >= need")
        met = materialize(met.drop("shared").join(enough.select("node", "shared"), "node"), "active")
    return met


def _central(met: DataFrame) -> DataFrame:
    """Each node v with the most central nodes u of its tokens, itself if it is one, their roots, and the tokens they share.

    Those nodes are central that have the most tokens in common with others: of near copies, those with the fewest changes.
    """
    rank = Window.partitionBy("token").orderBy(F.desc("shared"), "node")
    first = met.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= CENTRAL)
    first = first.select("token", F.col("node").alias("u"), F.col("root").alias("other"), F.col("shared").alias("weight"), "place")
    both = met.select("token", F.col("node").alias("v"), "root").join(first, "token")
    return both.groupBy("u", "v", "root", "other", "weight").agg(F.count("*").alias("met"), F.min("place").alias("place"))


def _groups(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """Group of each node, named by the first node of one of its tokens.

    The most central one of those it shares enough tokens with, or else the one it shares most with.
    """
    sized = near.where("place = 1").join(nodes.select(F.col("node").alias("v"), _need(F.col("n")).alias("need")), "v")
    enough = F.col("met") >= F.col("need")
    # A node that few tokens name first joins another one rather than itself.
    other = F.when(F.col("u") != F.col("v"), F.col("met")).otherwise(F.lit(0).cast("long"))
    rank = F.struct(enough.alias("enough"), F.when(enough, F.col("weight")).otherwise(other).alias("by"), "u")
    return sized.groupBy(F.col("v").alias("node")).agg(F.max(rank).alias("m")).select("node", F.col("m.u").alias("group"))


def _opened(docs: DataFrame, met: DataFrame, nodes: DataFrame, labels: DataFrame | None, groups: DataFrame, n: int) -> DataFrame:
    """Links of nodes to members of the groups that the bound does not close to them.

    Members are kept in blocks. Those that are linked to many others have blocks of their own, which only nodes with fewer
    links are compared with; the others share blocks.
    """
    sizes = _labelled(nodes.select("node"), labels).groupBy("root").agg(F.count("*").alias("size"))
    active = met.select("node", "root").distinct().join(sizes, "root").join(groups, "node", "left")
    # Few with many links, and the rest, which is worth 0 in the order of linked groups.
    active = active.withColumns({"group": F.coalesce("group", "node"), "size": F.when(F.col("size") >= BLOCK, F.col("size")).otherwise(0)})
    active = materialize(active.join(nodes.select("node", _need(F.col("n")).alias("need")), "node"), "members")

    query = met.select("token", "node").join(active.select("node", "group", "need", "size"), "node")
    matrix = query.groupBy("token", F.col("group").alias("to")).agg(F.max("size").alias("largest"))
    # A node with many links is asked by those with few, and itself asks only groups with such nodes.
    asks = (F.col("group") != F.col("to")) & ((F.col("size") == 0) | (F.col("largest") > 0))
    hits = query.join(matrix, "token").where(asks).groupBy("node", "to", "need").agg(F.count("*").alias("met"))
    qualified = hits.where("met >= need").select("node", "to")
    qualified = qualified.unionByName(active.select("node", F.col("group").alias("to")))

    # Blocks of a group: by linked group where that is large, and of bounded size.
    own = F.when(F.col("size") > 0, F.col("root"))
    many = active.groupBy("group", own.alias("own")).agg(F.count("*").alias("many"), F.first("size").alias("rank"))
    many = many.withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    block = F.xxhash64(F.col("group"), F.col("own"), F.pmod(F.col("node"), F.col("blocks")))
    members = _with_blocks(active.withColumn("own", own), many).select(block.alias("block"), F.lit(0).alias("role"), "node", "root")
    asked = qualified.join(active.select("node", "root", F.col("size").alias("mine")), "node")
    asked = asked.join(many.withColumnRenamed("group", "to"), "to")
    # Of two large linked groups the smaller asks; the rest asks all.
    asks = (F.col("mine") == 0) | (F.struct("mine", "root") < F.struct("rank", "own"))
    asked = asked.where(asks & ~F.col("root").eqNullSafe(F.col("own")))
    asked = asked.select("node", "root", F.col("to").alias("group"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    asked = asked.select(F.xxhash64("group", "own", F.col("part").cast("long")).alias("block"), F.lit(1).alias("role"), "node", "root")
    texts = materialize(_texts(docs, active.select("node"), n), "texts")
    rows = members.unionByName(asked).join(texts, "node").repartition("block").sortWithinPartitions("block", "role")
    return rows.select("block", "role", "node", "root", "text").mapInArrow(_compared(n), "u long, v long")


def _with_blocks(active: DataFrame, many: DataFrame) -> DataFrame:
    key = F.coalesce("own", F.lit(0).cast("long"))
    return active.withColumn("k", key).join(many.select("group", key.alias("k"), "blocks"), ["group", "k"])


def _compared(n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query row against all members of its block, exactly: one link for each linked group among them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, names, tokens = None, None, [], []
        for step in arrow.steps(batches, "text"):
            block, role, node, root = (np.asarray(step.column(i)).tolist() for i in range(4))
            u, v = [], []
            for b, r, q, own, mine in zip(block, role, node, root, Sets.of(step.column(4), n).tokens):
                if b != at:
                    at, index, names, tokens = b, None, [], []
                if r == 0:
                    names.append((q, own))
                    tokens.append(mine)
                    continue
                if index is None:
                    index = _Index(tokens)
                linked = {}
                for k in index.similar(mine):
                    if names[k][1] != own:
                        linked.setdefault(names[k][1], names[k][0])
                u += [q] * len(linked)
                v += linked.values()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


class _Index:
    """Which members of a block have a token."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.concatenate([*tokens, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.flat, self.member = flat[order], np.repeat(np.arange(len(tokens)), self.size)[order]

    def similar(self, tokens: np.ndarray) -> list[int]:
        """Members whose sets reach the similarity."""
        a, z = np.searchsorted(self.flat, tokens), np.searchsorted(self.flat, tokens, "right")
        many = z - a
        at = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(self.member[at], minlength=len(self.size))
        return np.flatnonzero(100 * both >= PERCENT * (self.size + len(tokens) - both)).tolist()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class, all columns kept: the row with the least id; every row without a word.

    Rows with a null id stay. Of rows with the same id, one stays.
    """
    found = classes(docs, id_col, text_col)
    ids = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(ids, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
