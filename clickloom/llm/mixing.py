"""Mix overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). Words flow from patterns to source
quotas; the r-th repetition of a pattern's words costs r - 1, so the cheapest flow repeats as little as possible. The
driver sees patterns and sources only. Documents are then taken in seeded order until their pattern's flow is used up.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import materialize

REPEATS = 3
SEED = "mix"
# Patterns the driver solves for; more is an error, not a cut.
MOST_PATTERNS = 100_000
# Hexadecimal digits of the seeded order that each of two rounds of bucket sums looks at.
DIGITS = 3

Name = str | None


def words(text: str | Column = "text") -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def in_order(sources: Sequence[Name]) -> list[Name]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def fill(sizes: dict[Name, int], weights: dict[Name, float], total: int, repeats: int = REPEATS) -> dict[Name, float]:
    """Each source's share of ``total`` by weight, at most ``repeats`` times its size; the excess goes to the others."""
    open_, out = in_order(sizes), {}
    rest = total
    while open_:
        weight = sum(weights[s] for s in open_)
        full = [s for s in open_ if repeats * sizes[s] * weight < weights[s] * rest]
        if not full:
            return out | {s: weights[s] * rest / weight if weight else 0.0 for s in open_}
        out |= {s: float(repeats * sizes[s]) for s in full}
        rest -= sum(repeats * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


@dataclass
class Arc:
    to: int
    room: int
    back: int


def route(patterns: list[tuple[tuple[Name, ...], int]], quotas: dict[Name, int], repeats: int = REPEATS) -> list[dict[Name, int]]:
    """Words each pattern sends to each source, as many as quotas allow, at the least repetition cost.

    Costs stand on the arcs into patterns alone, so the cheapest augmenting path is any path by the cheapest level that
    has one: each level of repetition in turn is filled by shortest augmenting paths.
    """
    names = in_order(quotas)
    first, sink = len(patterns) + 1, len(patterns) + len(names) + 1
    net: list[list[Arc]] = [[] for _ in range(sink + 1)]

    def join(a: int, b: int, room: int) -> Arc:
        net[a].append(Arc(b, room, len(net[b])))
        net[b].append(Arc(a, 0, len(net[a]) - 1))
        return net[a][-1]

    place = {s: first + i for i, s in enumerate(names)}
    into = [join(0, 1 + i, 0) for i in range(len(patterns))]
    out = []
    for i, (members, size) in enumerate(patterns):
        out.append({s: join(1 + i, place[s], repeats * size) for s in in_order(set(members)) if s in place})
    for s in names:
        join(place[s], sink, quotas[s])
    for _ in range(repeats):
        for arc, (_, size) in zip(into, patterns):
            arc.room += size
        while path := _path(net, sink):
            room = min(arc.room for _, arc in path)
            for _, arc in path:
                arc.room -= room
                net[arc.to][arc.back].room += room
    return [{s: repeats * size - arc.room for s, arc in arcs.items()} for (_, size), arcs in zip(patterns, out)]


def _path(net: list[list[Arc]], sink: int) -> list[tuple[int, Arc]]:
    """A shortest path with room from node 0, as (node, arc)."""
    came: dict[int, tuple[int, Arc]] = {}
    queue = deque([0])
    while queue and sink not in came:
        a = queue.popleft()
        for arc in net[a]:
            if arc.room > 0 and arc.to not in came and arc.to != 0:
                came[arc.to] = (a, arc)
                queue.append(arc.to)
    path, at = [], sink
    while at in came:
        path.append(came[at])
        at = came[at][0]
    return path


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text",
    sources: Column | str = "source", repeats: int = REPEATS, seed: str = SEED,
) -> DataFrame:
    """id, size, sources, source_size, target and taken of every document.

    ``sources`` is a name or an array of names. Sources in code point order, null last, weigh ``weights`` in turn and
    share all words of the table, each at most ``repeats`` times its own. ``target`` and ``source_size`` are those of the
    document's sources, summed. ``taken`` is at most ``repeats`` times the size; the document at which a pattern's flow
    ends may be taken in part. The order is an MD5 of seed and id, so reruns agree; rows with the same id are separate.
    Null and empty texts have size 0 and take nothing; an empty list of sources takes nothing; null is a source of its
    own; other columns are ignored; an empty table gives an empty one.
    """
    column = F.col(sources) if isinstance(sources, str) else sources
    listed = docs.select(F.col(id_col).alias("id"), words(text_col).alias("size"), column.alias("s"))
    if not listed.schema["s"].dataType.simpleString().startswith("array"):
        listed = listed.withColumn("s", F.array(F.col("s").cast("string")))
    listed = listed.withColumn("s", F.array_sort(F.array_distinct(F.coalesce("s", F.array().cast("array<string>")))))
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))
    # Texts are read once; what follows works on this narrow table.
    sized = materialize(listed.select("id", "size", "s", F.to_json("s").alias("pattern"), rank.alias("rank")), "sizes")
    found = sized.groupBy("pattern").agg(F.first("s").alias("s"), F.sum("size").alias("size")).orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    sizes: dict[Name, int] = {}
    for r in found:
        for s in r.s:
            sizes[s] = sizes.get(s, 0) + r.size
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(in_order(sizes))}
    targets = fill(sizes, weigh, sum(r.size for r in found if r.s), repeats)
    flows = route([(tuple(r.s), r.size) for r in found], {s: int(t + 0.5) for s, t in targets.items()}, repeats)
    plan = [
        (r.pattern, sum(sizes[s] for s in r.s), sum((targets[s] for s in in_order(r.s)), 0.0), *(divmod(sum(f.values()), r.size) if r.size else (0, 0)))
        for r, f in zip(found, flows)
    ]
    chosen = docs.sparkSession.createDataFrame(plan, "pattern string, source_size long, target double, rounds long, rest long")
    taken = _take(sized.join(F.broadcast(chosen), "pattern"))
    return taken.select(F.col("id").alias(id_col), "size", F.col("s").alias("sources"), "source_size", "target", "taken")


def _cell(at: int) -> Column:
    return F.substring("rank", 1 + at * DIGITS, DIGITS)


def _crossing(rows: DataFrame, at: int) -> DataFrame:
    """The bucket of each pattern in which its rest ends, and the words before it."""
    sums = rows.groupBy("pattern", "rest", "before", _cell(at).alias("cell")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("cell"))
    sums = sums.withColumn("before", F.col("before") + upto - F.col("size"))
    return sums.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))).select(
        "pattern", "cell", "before"
    )


def _take(rows: DataFrame) -> DataFrame:
    """All rows with ``taken``: full rounds, and the rest in the order of ``rank``.

    Two rounds of bucket sums (4096 each) find the bucket where a pattern's rest ends. Rows before it are taken once
    more, rows behind it are not; only the rows inside, 1 of 16 million, are put in order.
    """
    first = F.broadcast(_crossing(rows.withColumn("before", F.lit(0).cast("long")), 0).withColumnsRenamed({"cell": "cell1", "before": "before1"}))
    near = rows.join(first, "pattern", "left")
    inside = near.where(_cell(0) == F.col("cell1")).withColumn("before", F.col("before1"))
    second = F.broadcast(_crossing(inside, 1).withColumnsRenamed({"cell": "cell2", "before": "before2"}))
    near = near.join(second, "pattern", "left")
    cell = F.concat("cell1", "cell2")
    mine = F.substring("rank", 1, 2 * DIGITS)
    # A pattern without a crossing bucket has no rest.
    outside = near.where(cell.isNull() | (mine != cell)).withColumn(
        "more", F.when(mine < cell, F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    order = Window.partitionBy("pattern").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before2") + F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    left = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - start))
    both = outside.unionByName(near.where(mine == cell).withColumn("more", left))
    return both.withColumn("taken", F.col("rounds") * F.col("size") + F.col("more"))
