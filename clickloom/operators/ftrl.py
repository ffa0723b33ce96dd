"""FTRL-Proximal logistic regression in mini-batches over a state table.

The state ``(idx, z, n)`` is an ordinary table. A round scores its rows with the state
so far, sums the gradient per slot and writes the next state; weights are never stored
but derived from ``z`` and ``n`` when needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalar as fn
from clickloom.operators.encode import HASH_SIZE
from clickloom.operators.lookup import DEFAULT_LIMITS, lookup_join
from clickloom.operators.ordinal import global_ordinal
from clickloom.session import materialize

STATE_SCHEMA = "idx bigint, z double, n double"
WEIGHT_ROW_BYTES = 32
# Most slots of a row that are looked up place by place.
MOST_PLACES = 32
# Weights that a plan may hold, counted once a place.
PLAN_WEIGHTS = 1 << 19


@dataclass(frozen=True)
class Ftrl:
    """Learning-rate and regularisation settings."""

    alpha: float = 0.1
    beta: float = 0.1
    l1: float = 0.0
    l2: float = 0.0
    size: int = HASH_SIZE


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def save_state(state: DataFrame, path: str) -> str:
    state.select("idx", "z", "n").write.parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(path)


def lazy_weight(z: Column, n: Column, p: Ftrl) -> Column:
    """Weight of a slot; 0 while ``|z|`` is within the L1 penalty."""
    sign = fn.sign_or_one(z)
    step = (F.lit(p.beta) + F.sqrt(n)) / p.alpha + p.l2
    # A slot without any gradient has step 0 where beta and l2 are 0.
    moved = (sign * p.l1 - z) / F.nullif(step, F.lit(0.0))
    return F.when(sign * z <= p.l1, F.lit(0.0)).otherwise(moved)


def score(rows: DataFrame, state: DataFrame, p: Ftrl, width: int | None = None) -> DataFrame:
    """Add the click probability ``p`` to rows with hashed slots ``x``; a row without slots has even odds.

    Weights are looked up place by place of ``x``, so that each row sums its own and no row is moved: a small table is a value
    in the plan, one of bounded size is broadcast once for all places. Beyond that bound, or for long rows, weights are joined
    to the slots. ``width`` is the number of slots of the longest row, measured if it is not given.
    """
    weights = state.select("idx", lazy_weight(F.col("z"), F.col("n"), p).alias("w"))
    if p.size * WEIGHT_ROW_BYTES > DEFAULT_LIMITS.broadcast_bytes:
        return _score_by_join(rows, weights)
    if width is None:
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if width > MOST_PLACES:
        return _score_by_join(rows, weights)
    if p.size * width <= PLAN_WEIGHTS:
        # Named in every place and never a column: a column would be copied with every row.
        table = _weight_list(weights, p.size)
        found, parts = rows, [F.get(table.scalar(), F.get("x", F.lit(i)).cast("int")) for i in range(width)]
    else:
        found, parts = rows, [F.col(f"_w{i}") for i in range(width)]
        held = weights.where("w <> 0")
        for i in range(width):
            # The same table every time, so that one broadcast serves all places.
            place = F.broadcast(held.select(F.col("idx").alias(f"_idx{i}"), F.col("w").alias(f"_w{i}")))
            found = found.join(place, F.get("x", F.lit(i)) == F.col(f"_idx{i}"), "left")
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    return found.select(*rows.columns, fn.bounded_sigmoid(total).alias("p"))


def _weight_list(weights: DataFrame, size: int) -> DataFrame:
    """All weights as one array, slot ``idx`` at its place."""
    every = weights.sparkSession.range(size).select(F.col("id").alias("idx"), F.lit(0.0).alias("w"))
    whole = weights.unionByName(every).groupBy("idx").agg(F.sum("w").alias("w"))
    return whole.agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("all")).select(F.col("all.w").alias("weights"))


def _score_by_join(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``score`` with weights of any number.

    The slots of a row are summed inside its task before the shuffle. Rows that are copies
    of each other meet in one group and are multiplied out again.
    """
    long = rows.select("*", F.posexplode_outer("x").alias("pos", "idx"))
    known = lookup_join(long, weights, ["idx"], "left")
    # Every column is a grouping key, so that the aggregate stays a hash aggregate.
    sums = known.groupBy(*rows.columns).agg(
        F.sum(F.coalesce(F.col("w"), F.lit(0.0))).alias("_wx"),
        # A row without slots is one entry without a position.
        F.count(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1)).cast("int").alias("_copies"),
    )
    scored = sums.withColumn("p", fn.bounded_sigmoid(F.col("_wx") / F.col("_copies")))
    return scored.select(*rows.columns, "p", F.explode_outer(F.array_repeat(F.lit(0), F.col("_copies")))).drop("col")


def update(state: DataFrame, scored: DataFrame, p: Ftrl) -> DataFrame:
    """Next state, with the batch's losses on the side in ``loss`` and ``rows``.

    Rows with ``holdout`` = 1 are measured (``held_loss``, ``held_rows``) but not learnt.
    Old state and new gradients meet in one aggregate, combined before its shuffle, so a
    slot that occurs in every row is no hot key.
    """
    if "holdout" not in scored.columns:
        scored = scored.withColumn("holdout", F.lit(0))
    loss = fn.log_loss(F.col("p"), F.col("y"))
    learnt = F.col("holdout") == 0
    entries = scored.select("*", loss.alias("_loss"), F.posexplode_outer("x").alias("pos", "idx"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    # A row without slots is measured on the bias slot, which its missing entry does not move.
    moved = learnt & F.col("idx").isNotNull()
    grads = entries.select(
        F.coalesce("idx", F.lit(0)).alias("idx"),
        F.lit(0.0).alias("z"),
        F.lit(0.0).alias("n"),
        F.when(moved, F.col("p") - F.col("y")).otherwise(0.0).alias("g"),
        F.when(first & learnt, F.col("_loss")).alias("loss"),
        F.when(first & learnt, 1).otherwise(0).alias("rows"),
        F.when(first & ~learnt, F.col("_loss")).alias("held_loss"),
        F.when(first & ~learnt, 1).otherwise(0).alias("held_rows"),
    )
    old = state.select(
        "idx", "z", "n", F.lit(0.0).alias("g"),
        F.lit(None).cast("double").alias("loss"), F.lit(0).alias("rows"),
        F.lit(None).cast("double").alias("held_loss"), F.lit(0).alias("held_rows"),
    )
    merged = old.unionByName(grads).groupBy("idx").agg(
        *[F.sum(c).alias(c) for c in ("z", "n", "g", "loss", "rows", "held_loss", "held_rows")]
    )
    g, z, n = F.col("g"), F.col("z"), F.col("n")
    sigma = (F.sqrt(n + g * g) - F.sqrt(n)) / p.alpha
    return merged.select(
        "idx",
        (z + g - sigma * F.coalesce(lazy_weight(z, n, p), F.lit(0.0))).alias("z"),
        (n + g * g).alias("n"),
        "loss", "rows", "held_loss", "held_rows",
    )


def advance(state: DataFrame, rows: DataFrame, p: Ftrl, width: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """One round: score, learn, write the state; returns it with the round's losses."""
    done = materialize(update(state, score(rows, state, p, width), p), "ftrl")
    sums = done.agg(*[F.sum(c).alias(c) for c in ("loss", "rows", "held_loss", "held_rows")]).first()
    return done.select("idx", "z", "n"), {k: v or 0 for k, v in sums.asDict().items()}


def in_batches(rows: DataFrame, order_by: list[str], per_batch: int) -> DataFrame:
    """Rows numbered into batches of ``per_batch`` along ``order_by``, written one folder each."""
    placed = global_ordinal(rows, order_by, "_t")
    batch = F.floor(F.col("_t") / per_batch).cast("int")
    return materialize(placed.withColumn("batch", batch).drop("_t"), "batches", ("batch",))


@dataclass
class FtrlFit:
    """Final and best state with the per-round log."""

    state: DataFrame
    best_state: DataFrame
    log: list[dict[str, float]]


def fit(
    rows: DataFrame,
    p: Ftrl = Ftrl(),
    epochs: int = 5,
    batches: int | None = None,
    order_by: tuple[str, ...] = ("datetime", "ID"),
    rows_per_batch: int = 100_000,
) -> FtrlFit:
    """Train for ``epochs`` passes; keeps the state with the best holdout (or train) loss.

    A batch has ``rows_per_batch`` rows whatever the size of the table, or its share where ``batches`` fixes their number.
    """
    total = rows.count()
    per_batch = max(1, -(-total // batches)) if batches else rows_per_batch
    batches = max(1, -(-total // per_batch))
    staged = in_batches(rows, list(order_by), per_batch).drop(*order_by)
    width = staged.agg(F.max(F.size("x"))).first()[0] or 0
    state = best = empty_state(rows.sparkSession)
    log: list[dict[str, float]] = []
    lowest = None
    for epoch in range(epochs):
        sums = {"loss": 0.0, "rows": 0, "held_loss": 0.0, "held_rows": 0}
        for b in range(batches):
            state, part = advance(state, staged.where(F.col("batch") == b).drop("batch"), p, width)
            if part["rows"] + part["held_rows"]:
                log.append({"epoch": epoch, "batch": b, **part})
            sums = {k: sums[k] + part[k] for k in sums}
        kind = ("held_loss", "held_rows") if sums["held_rows"] else ("loss", "rows")
        mean = sums[kind[0]] / sums[kind[1]] if sums[kind[1]] else None
        if mean is not None and (lowest is None or mean < lowest):
            lowest, best = mean, state
    return FtrlFit(state, best, log)


def log_frame(spark: SparkSession, log: list[dict[str, float]]) -> DataFrame:
    """The per-round log, one row per round, with mean losses."""
    rows = [
        (
            int(r["epoch"]),
            int(r["batch"]),
            int(r["rows"]),
            float(r["loss"] / r["rows"]) if r["rows"] else None,
            int(r["held_rows"]),
            float(r["held_loss"] / r["held_rows"]) if r["held_rows"] else None,
        )
        for r in log
    ]
    return spark.createDataFrame(
        rows, "epoch int, batch int, rows bigint, loss double, held_rows bigint, held_loss double"
    )
