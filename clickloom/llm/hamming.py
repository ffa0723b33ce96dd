"""Exact nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments; an index has a row for each code and segment. A query probes all segment values within
a radius that grows round by round. After radius r in all m segments, every code within distance m (r + 1) - 1 has been met,
since it differs by at most r in some segment. A query ends once its k-th distance lies within that bound. Until then the
k-th distance so far says how many segments the next radius takes: with a of them at radius r and the others at r - 1, every
code within distance m r + a - 1 has been met.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import materialize

BITS = 64
K = 10
# Probes beyond this number are never broadcast: Spark takes them for no larger than the table of queries they are made from,
# and a broadcast table is built in the driver.
MOST_BROADCAST = 200_000


def sign_code(vector: str) -> Column:
    """Bit b is set where the sum of the components b, b + 64, … is positive; null without components or with a null."""
    bit = f"aggregate(filter({vector}, (x, i) -> i % {BITS} = b), CAST(0 AS DOUBLE), (s, x) -> s + x) > 0"
    code = F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (acc, b) -> acc | if({bit}, shiftleft(1L, b), 0L))")
    whole = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.when(whole, code)


def segments(codes: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments: three bits fewer than the number of codes has, so that about eight share a value.

    Wider ones need many more probes, of which most meet nothing; narrower ones meet more codes that are not near.
    """
    m = min(8, max(2, round(BITS / max(1.0, log2(max(codes, 2)) - 3))))
    cuts = [BITS * j // m for j in range(m + 1)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:])]


def _part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, radius: int) -> Column:
    """All numbers of ``width`` bits with ``radius`` bits set, as one literal."""
    numbers = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _first(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of each key with the least distance, then id; ranked before they are shuffled, too."""
    order = Window.partitionBy(key).orderBy("distance", "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """query_id, place (1 to k), id and distance: for every query row, the k nearest rows with another id.

    Both tables have an id and a 64-bit code. Ties in distance go to the lesser id. Rows without code or id are neither
    found nor asked for; a query with fewer than k other ids gets what there is; an id that is repeated counts once, with
    its least code; other columns are ignored. Rows with the same code are one code of the index, which keeps its k + 1
    least ids: no more of them can be among anybody's k nearest. Queries with the same code are searched once.
    """
    rows, queries = (
        t.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).dropna().groupBy("id").agg(F.min("code").alias("code"))
        for t in (rows, queries)
    )
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    codes = materialize(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    parts = segments(codes.count())
    index = codes.select("code", "ids", F.explode(F.array(*_numbered(parts))).alias("p")).select("code", "ids", "p.seg", "p.value")
    index = materialize(index, "index")
    # bound: no code beyond this distance is wanted.
    asked = queries.select(F.col("code").alias("query"), F.lit(BITS).alias("bound")).distinct()
    todo, best = materialize(asked, "todo"), None
    for radius in range(max(w for _, w in parts) + 1):
        found = _probe(todo, index, parts, radius)
        if best is not None:
            found = found.unionByName(best)
        best = materialize(_first(found, "query", k + 1), "best")
        covered = len(parts) * (radius + 1) - 1
        if covered >= BITS:
            break
        # Finished: k + 1 rows within the distance that is covered. What is found of the others stays.
        seen = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        bound = F.when(F.col("n") > k, F.col("last")).otherwise(BITS).alias("bound")
        todo = materialize(todo.select("query").join(seen, "query", "left").select("query", bound).where(F.col("bound") > covered), "todo")
        if todo.isEmpty():
            break
    own = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    near = own.join(best, "query").where(F.col("query_id") != F.col("id"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return near.select("query_id", "place", "id", "distance")


def _numbered(parts: list[tuple[int, int]], code: str = "code") -> list[Column]:
    return [F.struct(F.lit(j).alias("seg"), _part(F.col(code), s, w).alias("value")) for j, (s, w) in enumerate(parts)]


def _probe(todo: DataFrame, index: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(query, id, distance) of codes within the bound that differ by exactly ``radius`` in some segment and by less in none.

    A code that several segments meet is given by the first of them. Segments the bound does not need are not probed; codes
    that only they meet lie beyond it.
    """
    probes, made = None, 0
    asked = todo.count()
    for j, (shift, width) in enumerate(parts):
        if radius > width:
            continue
        made += asked * comb(width, radius)
        near = todo.where(F.col("bound") >= len(parts) * radius + j)
        one = near.select("query", "bound", F.lit(j).alias("seg"), F.explode(_values(shift, width, radius)).alias("value"))
        probes = one if probes is None else probes.unionByName(one)
    met = (probes if made <= MOST_BROADCAST else probes.hint("merge")).join(index, ["seg", "value"])
    apart = F.col("query").bitwiseXOR(F.col("code"))
    gaps = F.array(*[F.bit_count(_part(apart, s, w)) for s, w in parts])
    first = (F.array_min(gaps) == radius) & (F.array_position(gaps, radius) == F.col("seg") + 1)
    distance = F.bit_count(apart)
    return met.where(first & (distance <= F.col("bound"))).select("query", F.explode("ids").alias("id"), distance.alias("distance"))


def _values(shift: int, width: int, radius: int) -> Column:
    own = _part(F.col("query"), shift, width)
    return F.transform(_masks(width, radius), lambda m: own.bitwiseXOR(m))
