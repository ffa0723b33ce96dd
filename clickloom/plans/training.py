"""Queries over single steps of training, each checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.models import boosting, frame
from clickloom.models.grow import Growth
from clickloom.operators import factorise, target
from clickloom.plans.features import prepared, unit_sql
from clickloom.plans.registry import IMP, PREP, SPARSE, hash32_sql, query, rounded
from clickloom.sources import samples

# Boosted stumps on features of two values.

STUMPS = {
    "mobile": "CASE WHEN devid = 'Mobile' THEN 1.0 ELSE 0.0 END",
    "afternoon": "CASE WHEN thour >= 12 THEN 1.0 ELSE 0.0 END",
    "high_category": "CASE WHEN category > 25 THEN 1.0 ELSE 0.0 END",
    "high_merchant": "CASE WHEN merchant > 25 THEN 1.0 ELSE 0.0 END",
}
STUMP_ROUNDS, STUMP_STEP = 3, 0.3


def _stumps_sql() -> str:
    """Each round in SQL: gradients per cell of the features, the gain of each feature, Newton steps of its two sides."""
    names = list(STUMPS)
    keys = ", ".join(names)
    steps = []
    for k in range(STUMP_ROUNDS):
        sides = " UNION ALL ".join(
            f"SELECT {i} AS f, coalesce(sum(g) FILTER (WHERE {c} = 0), 0) AS lg, coalesce(sum(h) FILTER (WHERE {c} = 0), 0) AS lh, "
            f"coalesce(sum(g) FILTER (WHERE {c} = 1), 0) AS rg, coalesce(sum(h) FILTER (WHERE {c} = 1), 0) AS rh FROM grad{k}"
            for i, c in enumerate(names)
        )
        value = "CASE b.f " + " ".join(f"WHEN {i} THEN CASE WHEN {c} = 0 THEN lv ELSE rv END" for i, c in enumerate(names)) + " END"
        steps.append(f"""grad{k} AS MATERIALIZED (SELECT *, n / (1 + exp(-m{k})) - s AS g, n / (1 + exp(-m{k})) * (1 - 1 / (1 + exp(-m{k}))) AS h FROM cells{k}),
        best{k} AS MATERIALIZED (SELECT f, -{STUMP_STEP} * lg / (lh + 1) AS lv, -{STUMP_STEP} * rg / (rh + 1) AS rv FROM ({sides})
          WHERE least(lh, rh) >= 1 ORDER BY lg * lg / (lh + 1) + rg * rg / (rh + 1) DESC, f LIMIT 1),
        cells{k + 1} AS MATERIALIZED (SELECT c.*, m{k} + {value} AS m{k + 1} FROM cells{k} c, best{k} b)""")
    margins = ", ".join(f"round(m{k + 1}, 6) AS margin_{k + 1}" for k in range(STUMP_ROUNDS))
    flags = ", ".join(f"{e} AS {c}" for c, e in STUMPS.items())
    return f"""WITH {PREP}, flagged AS (SELECT ID, split, CAST(click AS DOUBLE) AS y, {flags} FROM prep),
    cells0 AS MATERIALIZED (SELECT {keys}, count(*) FILTER (WHERE split = 'train') AS n, coalesce(sum(y) FILTER (WHERE split = 'train'), 0) AS s,
      (SELECT ln(avg(y) / (1 - avg(y))) FROM flagged WHERE split = 'train') AS m0 FROM flagged GROUP BY {keys}),
    {", ".join(steps)}
    SELECT ID, {margins} FROM flagged JOIN cells{STUMP_ROUNDS} USING ({keys}) WHERE split = 'test'"""


@query("boost_rounds", _stumps_sql())
def boost_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of the test rows after each of the first rounds, from the base score on."""
    df = prepared(spark, sf_dir).withColumns({c: F.expr(e).cast("double") for c, e in STUMPS.items()})
    wide = frame.assemble(df, list(STUMPS))
    settings = boosting.Boosting(rounds=STUMP_ROUNDS, step=STUMP_STEP, chunk=2, growth=Growth(depth=1))
    model = boosting.fit(frame.train_part(wide).select("ID", "label", "features"), settings)
    staged = frame.test_part(wide).select("ID", model.staged(F.col("features")).alias("m"))
    names = [f"margin_{k + 1}" for k in range(STUMP_ROUNDS)]
    return rounded(staged.select("ID", *[F.col("m")[k].alias(n) for k, n in enumerate(names)]), *names)


# Click rates of earlier rows.

RATED = target.combinations_of(["devid", "countrycode"])


def _rates_sql() -> str:
    train, test = [], []
    for combo in RATED:
        by, name = ", ".join(combo), target.rate_name(combo)
        window = f"(PARTITION BY {by} ORDER BY place, ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        train.append(f"round((coalesce(sum(click) OVER {window}, 0) + 10 * mean) / (count(click) OVER {window} + 10), 9) AS {name}")
        same = " AND ".join(f"r.{c} IS NOT DISTINCT FROM t.{c}" for c in combo)
        test.append(f"(SELECT round((coalesce(sum(r.click), 0) + 10 * t.mean) / (count(*) + 10), 9) FROM learn r WHERE {same}) AS {name}")
    return f"""WITH {IMP}, rows AS (SELECT ID, devid, countrycode, CAST(click AS DOUBLE) AS click, split, {hash32_sql("ID || '_order'")} AS place,
      (SELECT avg(click) FROM imp WHERE split = 'train') AS mean FROM imp),
    learn AS MATERIALIZED (SELECT * FROM rows WHERE split = 'train')
    SELECT ID, split, {", ".join(train)} FROM learn
    UNION ALL SELECT ID, split, {", ".join(test)} FROM rows t WHERE split = 'test'"""


@query("ordered_rates", _rates_sql())
def ordered_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two categories and their pair as click rates: of earlier rows for the train rows, of all train rows for the others."""
    imps = samples.impressions(spark, sf_dir).select("ID", "split", "devid", "countrycode", "click")
    train, (test,) = target.ordered_rates(imps.where("split = 'train'"), [imps.where("split = 'test'")], RATED, "click", bucket_rows=2000)
    both = train.unionByName(test)
    names = [target.rate_name(c) for c in RATED]
    return rounded(both.select("ID", "split", *names), *names, digits=9)


# Factorisation machines.

MACHINE = factorise.Machine(factors=2, rate=0.1, l2=0.01, l2_factors=0.02)
BATCHES = 2


def _machine_sql(m: factorise.Machine) -> str:
    fs = range(m.factors)
    start = ", ".join(f"""(2 * {unit_sql(f"idx || '_{f}_{m.seed}'")} - 1) * {m.spread} AS v{f}""" for f in fs)
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS {c}{f}" for f in fs for c in ("mv", "qv"))
    zero = "CAST(0 AS DOUBLE)"
    parts = [f"""rows AS MATERIALIZED (SELECT vec_id, CAST(y AS DOUBLE) AS y, idx, value, {hash32_sql("vec_id || '_batch'")} % {BATCHES} AS batch FROM sparse),
    p0 AS MATERIALIZED (SELECT idx, {zero} AS w, {zero} AS mw, {zero} AS qw, {start}, {zeros} FROM (SELECT DISTINCT idx FROM rows))"""]
    lead = m.momentum if m.rule == "nesterov" else 0.0

    def moved(value: str, first: str, second: str, g: str, l2: float, step: int) -> list[tuple[str, str]]:
        g = f"({g} + {l2} * {value})"
        if m.rule == "adam":
            f, s = f"({m.beta1} * {first} + {1 - m.beta1} * {g})", f"({m.beta2} * {second} + {1 - m.beta2} * {g} * {g})"
            rate = m.rate * (1 - m.beta2**step) ** 0.5 / (1 - m.beta1**step)
            return [(f"{value} - {rate} * {f} / (sqrt({s}) + {factorise.ADAM_SMALL})", value), (f, first), (s, second)]
        f = f"({m.momentum} * {first} - {m.rate} * {g})"
        return [(f"{value} + {f}", value), (f, first), (second, second)]

    for k in range(BATCHES):
        ahead = ", ".join(f"v{f} + {lead} * mv{f} AS v{f}" for f in fs)
        sums = ", ".join(f"sum(v{f} * value) AS s{f}" for f in fs)
        pairs = " + ".join(f"sum(v{f} * value) * sum(v{f} * value) - sum(v{f} * value * v{f} * value)" for f in fs)
        grads = ", ".join(f"sum(r * value * (s{f} - v{f} * value)) / (SELECT count(*) FROM s{k}) AS g{f}" for f in fs)
        new = moved("w", "mw", "qw", "gw", m.l2, k + 1)
        for f in fs:
            new += moved(f"v{f}", f"mv{f}", f"qv{f}", f"g{f}", m.l2_factors, k + 1)
        columns = ", ".join(f"CASE WHEN gw IS NULL THEN {name} ELSE {expr} END AS {name}" for expr, name in new)
        parts.append(f"""e{k} AS MATERIALIZED (SELECT vec_id, y, idx, value, w, {", ".join(f"v{f}" for f in fs)} FROM rows
          JOIN (SELECT idx, w + {lead} * mw AS w, {ahead} FROM p{k}) USING (idx) WHERE batch = {k}),
        s{k} AS MATERIALIZED (SELECT vec_id, 1 / (1 + exp(-(sum(w * value) + 0.5 * ({pairs})))) - any_value(y) AS r, {sums} FROM e{k} GROUP BY vec_id),
        g{k} AS MATERIALIZED (SELECT idx, sum(r * value) / (SELECT count(*) FROM s{k}) AS gw, {grads} FROM e{k} JOIN s{k} USING (vec_id) GROUP BY idx),
        p{k + 1} AS MATERIALIZED (SELECT idx, {columns} FROM p{k} LEFT JOIN g{k} USING (idx))""")
    values = ", ".join(f"round(v{f}, 6) AS v{f}" for f in fs)
    return f"WITH {SPARSE}, {', '.join(parts)} SELECT idx, round(w, 6) AS w, {values} FROM p{BATCHES}"


def _machine(spark: SparkSession, sf_dir: str, m: factorise.Machine) -> DataFrame:
    rows = samples.sparse_rows(spark, sf_dir).select(F.col("vec_id").alias("ID"), "y", F.col("features").alias("x"))
    p = factorise.fit(rows, m, epochs=1, batches=BATCHES).weights
    names = [f"v{f}" for f in range(m.factors)]
    return rounded(p.select("idx", "w", *[F.col("v")[f].alias(n) for f, n in enumerate(names)]), "w", *names)


@query("fm_momentum_rounds", _machine_sql(MACHINE))
def fm_momentum_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and factors after a step on each half of the rows, with Nesterov's momentum."""
    return _machine(spark, sf_dir, MACHINE)


ADAM = factorise.Machine(factors=2, rule="adam", rate=0.02, l2_factors=0.01)


@query("fm_adam_rounds", _machine_sql(ADAM))
def fm_adam_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after two steps of Adam."""
    return _machine(spark, sf_dir, ADAM)
