"""Training of factorisation machines on sparse rows, with the parameters in a table.

The table has a row for each slot that occurs: weight, factors, and what the update rule remembers of either. A batch scores
its rows by a lookup of their slots, sums the gradients per slot (combined before the shuffle, so the bias slot, present in
every row, is no hot key) and merges them into a new table. Nothing is as long as the number of slots there could be.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalar as fn
from clickloom.operators.lookup import lookup_join
from clickloom.session import materialize

ADAM_SMALL = 1e-8


@dataclass(frozen=True)
class Machine:
    """Settings. ``rule`` is ``momentum``, ``nesterov`` or ``adam``; ``loss`` is ``logistic`` or ``squared``."""

    factors: int = 4
    rule: str = "nesterov"
    loss: str = "logistic"
    rate: float = 0.01
    momentum: float = 0.9
    beta1: float = 0.9
    beta2: float = 0.999
    l2: float = 0.0
    l2_factors: float = 0.0
    spread: float = 0.01
    dropout: float = 0.0
    seed: str = "fm"


@dataclass(frozen=True)
class Fitted:
    """Parameters of the best epoch and the mean losses ``(epoch, loss, held_loss)``; held_loss is None without held rows."""

    weights: DataFrame
    log: list[tuple[int, float, float | None]]
    best_epoch: int


def _start(idx: Column, f: int, m: Machine) -> Column:
    """The first value of a factor: uniform within ``spread`` of 0, by a hash of slot and factor."""
    return (2.0 * fn.unit_hash(idx, F.lit(f), seed=m.seed) - 1.0) * F.lit(m.spread)


def parameters(rows: DataFrame, m: Machine) -> DataFrame:
    """``(idx, w, v, mw, mv, qw, qv)`` of every slot in ``rows``: values, first and second moments."""
    slots = rows.select(F.explode("x").alias("e")).select(F.col("e.idx").alias("idx")).distinct()
    return with_start(slots, m)


def with_start(slots: DataFrame, m: Machine) -> DataFrame:
    zeros = F.array(*[F.lit(0.0)] * m.factors)
    v = F.array(*[_start(F.col("idx"), f, m) for f in range(m.factors)])
    zero = F.lit(0.0)
    return slots.select("idx", zero.alias("w"), v.alias("v"), zero.alias("mw"), zeros.alias("mv"), zero.alias("qw"), zeros.alias("qv"))


def _lookahead(p: DataFrame, m: Machine) -> DataFrame:
    """Parameters at which the gradient is taken: for Nesterov's rule, where momentum leads."""
    if m.rule != "nesterov":
        return p.select("idx", "w", "v")
    ahead = F.zip_with("v", "mv", lambda v, s: v + m.momentum * s)
    return p.select("idx", (F.col("w") + m.momentum * F.col("mw")).alias("w"), ahead.alias("v"))


def entries(rows: DataFrame, p: DataFrame, m: Machine) -> DataFrame:
    """``(ID, y, idx, value, w, v)`` per entry; an unknown slot has no weight."""
    long = rows.select("ID", "y", F.explode("x").alias("e")).select("ID", "y", "e.idx", "e.value")
    return lookup_join(long, p, ["idx"], "left")


def scores(rows: DataFrame, p: DataFrame, m: Machine) -> DataFrame:
    """``(ID, y, s, margin)``: per factor the sums of v x, and the score."""
    known = entries(rows, p, m)
    x = F.col("value")
    terms = [F.coalesce(F.col("v")[f], F.lit(0.0)) * x for f in range(m.factors)]
    sums = known.groupBy("ID").agg(
        F.first("y").alias("y"),
        F.sum(F.coalesce(F.col("w"), F.lit(0.0)) * x).alias("linear"),
        F.array(*[F.sum(t) for t in terms]).alias("s"),
        *[F.sum(t * t).alias(f"q{f}") for f, t in enumerate(terms)],
    )
    pairs = fn.total([F.col("s")[f] * F.col("s")[f] - F.col(f"q{f}") for f in range(m.factors)])
    return sums.select("ID", "y", "s", (F.col("linear") + 0.5 * pairs).alias("margin"))


def prediction(margin: Column, m: Machine) -> Column:
    return fn.sigmoid(margin) if m.loss == "logistic" else margin


def row_loss(margin: Column, y: Column, m: Machine) -> Column:
    return fn.log_loss(fn.sigmoid(margin), y) if m.loss == "logistic" else (margin - y) * (margin - y)


def gradients(rows: DataFrame, p: DataFrame, m: Machine) -> tuple[DataFrame, DataFrame]:
    """``(idx, gw, gv)``: mean gradients over the rows, and the scored rows."""
    at = _lookahead(p, m)
    scored = materialize(scores(rows, at, m), "scored")
    n = F.lit(float(max(1, scored.count())))
    residual = prediction(F.col("margin"), m) - F.col("y")
    # Rows meet their own entries again by ID, on which both sides are dealt.
    known = entries(rows, at, m).drop("y").join(scored.select("ID", "s", residual.alias("r")), "ID")
    x = F.col("value")
    sums = known.groupBy("idx").agg(
        F.sum(F.col("r") * x).alias("gw"),
        *[F.sum(F.col("r") * x * (F.col("s")[f] - F.coalesce(F.col("v")[f], F.lit(0.0)) * x)).alias(f"g{f}") for f in range(m.factors)],
    )
    return sums.select("idx", (F.col("gw") / n).alias("gw"), F.array(*[F.col(f"g{f}") / n for f in range(m.factors)]).alias("gv")), scored


def _moved(value: Column, first: Column, second: Column, g: Column, l2: float, m: Machine, step: int) -> tuple[Column, Column, Column]:
    """Value and moments after a step."""
    g = g + l2 * value
    if m.rule == "adam":
        first, second = m.beta1 * first + (1 - m.beta1) * g, m.beta2 * second + (1 - m.beta2) * g * g
        rate = m.rate * (1 - m.beta2**step) ** 0.5 / (1 - m.beta1**step)
        return value - rate * first / (F.sqrt(second) + ADAM_SMALL), first, second
    first = m.momentum * first - m.rate * g
    return value + first, first, second


def advance(p: DataFrame, rows: DataFrame, m: Machine, step: int) -> tuple[DataFrame, DataFrame]:
    """Parameters after one batch, and its scored rows. Slots the batch does not have stay as they are."""
    g, scored = gradients(rows, p, m)
    both = p.join(g, "idx", "left")
    w, mw, qw = _moved(F.col("w"), F.col("mw"), F.col("qw"), F.col("gw"), m.l2, m, step)
    parts = [
        _moved(F.col("v")[f], F.col("mv")[f], F.col("qv")[f], F.col("gv")[f], m.l2_factors, m, step) for f in range(m.factors)
    ]
    names = ["w", "v", "mw", "mv", "qw", "qv"]
    new = [w, F.array(*[c[0] for c in parts]), mw, F.array(*[c[1] for c in parts]), qw, F.array(*[c[2] for c in parts])]
    touched = F.col("gw").isNotNull()
    return both.select("idx", *[F.when(touched, value).otherwise(F.col(name)).alias(name) for name, value in zip(names, new)]), scored


def fit(train: DataFrame, m: Machine, epochs: int, batches: int = 1, held: DataFrame | None = None, seed: str = "batch") -> Fitted:
    """Fit on ``(ID, y, x)`` rows, x an array of ``(idx, value)``; IDs are unique.

    Batches are dealt by a hash of the ID. The parameters of the epoch with the least loss on ``held`` rows are kept, or on
    the train rows without them; of equal ones, the first. An empty table gives no parameters.
    """
    rows = train.select("ID", F.col("y").cast("double").alias("y"), "x")
    if m.dropout:
        kept = F.filter("x", lambda e: fn.unit_hash(F.col("ID"), e["idx"], seed=m.seed) >= m.dropout)
        rows = rows.select("ID", "y", F.transform(kept, lambda e: F.struct(e["idx"].alias("idx"), e["value"].alias("value"))).alias("x"))
    rows = materialize(rows.withColumn("batch", F.pmod(fn.hash32(F.col("ID"), F.lit(seed)), F.lit(batches))), "fm_rows")
    p = materialize(parameters(rows, m), "fm")
    best, best_loss, best_epoch, log, step = p, None, 0, [], 0
    for epoch in range(epochs):
        losses = []
        for b in range(batches):
            step += 1
            new, scored = advance(p, rows.where(F.col("batch") == b).drop("batch"), m, step)
            p = materialize(new, "fm")
            losses.append(scored.agg(F.sum(row_loss(F.col("margin"), F.col("y"), m)), F.count("*")).first())
        n = sum(c for _, c in losses)
        loss = sum(s or 0.0 for s, _ in losses) / n if n else 0.0
        held_loss = None
        if held is not None:
            held_loss = scores(held, p.select("idx", "w", "v"), m).agg(F.avg(row_loss(F.col("margin"), F.col("y").cast("double"), m))).first()[0]
        judged = loss if held_loss is None else held_loss
        log.append((epoch, loss, held_loss))
        if best_loss is None or judged < best_loss:
            best, best_loss, best_epoch = p, judged, epoch
    return Fitted(best, log, best_epoch)


def score(rows: DataFrame, weights: DataFrame, m: Machine, name: str = "click") -> DataFrame:
    """``(ID, name)`` of sparse rows; a row without entries has margin 0."""
    filled = rows.select("ID", F.lit(None).cast("double").alias("y"), _never_empty(F.col("x")).alias("x"))
    found = scores(filled, weights.select("idx", "w", "v"), replace(m, dropout=0.0))
    return found.select("ID", prediction(F.col("margin"), m).alias(name))


def _never_empty(x: Column) -> Column:
    """An entry of value 0 in rows without any, so that they are scored."""
    nothing = F.array(F.struct(F.lit(0).cast("bigint").alias("idx"), F.lit(0.0).alias("value")))
    plain = F.transform(x, lambda e: F.struct(e["idx"].cast("bigint").alias("idx"), e["value"].cast("double").alias("value")))
    return F.when(F.size(x) > 0, plain).otherwise(nothing)


def slots(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """``(ID, x)`` with a hashed slot of value 1 per column, after the bias in slot 0."""
    tokens = [F.lit(0).cast("bigint"), *[fn.token_index(c, F.coalesce(F.col(c).cast("string"), F.lit("")), size - 1) + 1 for c in columns]]
    # Two columns may share a slot; it then has the sum.
    # A column, so that it is hashed once a row and not for every entry it is compared with.
    each = F.col("_each")
    counted = F.transform(F.array_distinct(each), lambda i: F.struct(i.alias("idx"), F.size(F.filter(each, lambda j: j == i)).cast("double").alias("value")))
    return df.withColumn("_each", F.array(*tokens)).withColumn("x", counted).drop("_each")
