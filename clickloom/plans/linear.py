"""Queries over sparse scores, factorisation machines, naive Bayes and FTRL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.models.online import FtrlEstimator, FtrlModel
from clickloom.operators import encode, ftrl, naive_bayes, sparse, split
from clickloom.plans.features import HASHED, SLOTS, SLOT_LIST, hashable, prepared, unit_sql
from clickloom.plans.registry import PREP, SPARSE, hash32_sql, query, rounded
from clickloom.session import materialize, new_path
from clickloom.sources import readers, samples, writers

FACTORS = 4


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = sparse.to_long(samples.sparse_rows(spark, sf_dir), ["vec_id"])
    path = writers.write_weights(samples.fm_weights(long, FACTORS), new_path(spark, "weights"))
    return readers.read_weights(spark, path)


@query(
    "linear_score",
    f"WITH {SPARSE} SELECT vec_id, round(sum(round(sin(idx + 1), 6) * value) + 0.1, 6) AS score FROM sparse GROUP BY vec_id",
)
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.sparse_rows(spark, sf_dir)
    return rounded(sparse.linear_score(rows, weights(spark, sf_dir), "vec_id", bias=0.1), "score")


@query(
    "fm_score",
    f"""WITH {SPARSE}, d AS (SELECT vec_id, f, sum(v) AS s, sum(v * v) AS q FROM (
        SELECT vec_id, f.f, round(sin(idx * 5 + f.f), 6) * value AS v FROM sparse, range({FACTORS}) f(f)) GROUP BY vec_id, f),
    pairs AS (SELECT vec_id, 0.5 * sum(s * s - q) AS p FROM d GROUP BY vec_id),
    linear AS (SELECT vec_id, sum(round(sin(idx + 1), 6) * value) AS l FROM sparse GROUP BY vec_id)
    SELECT vec_id, round(p + l + 0.1, 6) AS score FROM pairs JOIN linear USING (vec_id)""",
)
def fm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.sparse_rows(spark, sf_dir)
    return rounded(sparse.fm_score(rows, weights(spark, sf_dir), "vec_id", FACTORS, bias=0.1), "score")


FIELDS = ["offerid", "category", "merchant", "countrycode", "devid"]


def field_tables(df: DataFrame) -> dict[str, DataFrame]:
    """An embedding row per value of each field, from the value's hash; one pass for all fields."""

    def entry(i: int, c: str) -> Column:
        slot = encode.hash_tokens([c], 1000)[0]
        return F.struct(
            F.lit(c).alias("field"), F.lit(i).alias("i"), F.col(c).cast("string").alias("value"), slot.alias("slot")
        )

    entries = df.select(F.explode_outer(F.array(*[entry(i, c) for i, c in enumerate(FIELDS)])).alias("e")).select("e.*")
    slot = F.col("slot")
    v = F.array(*[F.round(F.sin(slot * (F.col("i") + 1) + f), 6) for f in range(FACTORS)])
    values = entries.where("value IS NOT NULL").distinct()
    table = materialize(values.select("field", "value", F.round(F.cos(slot), 6).alias("w"), v.alias("v")), "fields", ("field",))
    return {
        c: table.where(F.col("field") == c).select(F.col("value").cast(df.schema[c].dataType).alias(c), "w", "v")
        for c in FIELDS
    }


def _field_sql() -> str:
    slots = ", ".join(f"""{hash32_sql(f"'{c}_' || {c}")} % 1000 AS s{i}""" for i, c in enumerate(FIELDS))
    v = [[f"round(sin(s{i} * {i + 1} + {f}), 6)" for f in range(FACTORS)] for i in range(len(FIELDS))]
    terms = [f"round(cos(s{i}), 6)" for i in range(len(FIELDS))]
    for i in range(len(FIELDS)):
        for j in range(i + 1, len(FIELDS)):
            terms += [f"{v[i][f]} * {v[j][f]}" for f in range(FACTORS)]
    return f"""WITH {PREP}, s AS (SELECT ID, {slots} FROM prep), t AS (SELECT ID, {" + ".join(terms)} AS score FROM s)
    SELECT ID, round(score, 6) AS score, round(1 / (1 + exp(-score)), 6) AS click FROM t"""


@query("fm_score_pairwise", _field_sql())
def fm_score_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(spark, sf_dir)
    return rounded(sparse.fm_score_fields(df, field_tables(df), "ID"), "score", "click")


NB_FEATURES = ["siteid", "tweekday", "thour", "tminute", "site_open"]


def nb_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(spark, sf_dir)
    mobile = F.when(F.col("devid") == "Mobile", 1).otherwise(0)
    return df.withColumn("site_open", mobile)


def _nb_sql() -> str:
    on = ", ".join(f"sum(CASE WHEN {c} > 0 THEN 1 ELSE 0 END) AS on_{c}" for c in NB_FEATURES)
    terms = " + ".join(
        f"ln(CASE WHEN t.{c} > 0 THEN (m.on_{c} + 1) / CAST(m.n + 2 AS DOUBLE) ELSE 1 - (m.on_{c} + 1) / CAST(m.n + 2 AS DOUBLE) END)"
        for c in NB_FEATURES
    )
    return f"""WITH {PREP}, f AS (SELECT *, CASE WHEN devid = 'Mobile' THEN 1 ELSE 0 END AS site_open FROM prep),
    m AS (SELECT click, count(*) AS n, {on} FROM f WHERE split = 'train' GROUP BY click),
    j AS (SELECT t.ID, m.click AS k, ln(m.n / CAST((SELECT sum(n) FROM m) AS DOUBLE)) + {terms} AS l
      FROM f t, m WHERE t.split = 'test'),
    w AS (SELECT ID, max(l) FILTER (WHERE k = 0) AS l0, max(l) FILTER (WHERE k = 1) AS l1 FROM j GROUP BY ID)
    SELECT ID, round(1 / (1 + exp(l0 - l1)), 6) AS probability, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS prediction FROM w"""


@query("bernoulli_nb", _nb_sql())
def bernoulli_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nb_frame(spark, sf_dir)
    model = naive_bayes.fit_bernoulli_nb(df.where("split = 'train'"), NB_FEATURES)
    scored = model.transform(df.where("split = 'test'"))
    return rounded(scored.select("ID", "probability", "prediction"), "probability")


def ftrl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows with hashed slots; the ID and the label are never hashed."""
    train = hashable(spark, sf_dir).where("split = 'train'")
    return encode.hash_features(train, HASHED).select("ID", "datetime", F.col("click").cast("double").alias("y"), "x")


def _round_sql(batch: str, state: str | None, out: str) -> str:
    """One FTRL round in SQL with alpha = beta = 0.1 and no penalties: scores, losses, state."""
    weight = f"(SELECT idx, CASE WHEN z = 0 THEN 0 ELSE -z / ((0.1 + sqrt(n)) / 0.1) END AS w, z, n FROM {state})" if state else (
        "(SELECT CAST(0 AS BIGINT) AS idx, 0.0 AS w, CAST(0 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS n WHERE false)"
    )
    return f"""{out}_w AS MATERIALIZED {weight},
    {out}_p AS MATERIALIZED (SELECT ID, any_value(y) AS y, any_value(held) AS held,
      1 / (1 + exp(-greatest(least(sum(COALESCE(w, 0)), 35.0), -35.0))) AS p
      FROM long LEFT JOIN {out}_w USING (idx) WHERE {batch} GROUP BY ID),
    {out}_l AS (SELECT held, CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END AS loss FROM {out}_p),
    {out}_g AS MATERIALIZED (SELECT idx, sum(p - {out}_p.y) AS g FROM long JOIN {out}_p USING (ID) WHERE {out}_p.held = 0 GROUP BY idx),
    {out} AS MATERIALIZED (SELECT COALESCE(s.idx, d.idx) AS idx,
      COALESCE(z, 0) + COALESCE(g, 0) - (sqrt(COALESCE(n, 0) + COALESCE(g, 0) * COALESCE(g, 0)) - sqrt(COALESCE(n, 0))) / 0.1 * COALESCE(w, 0) AS z,
      COALESCE(n, 0) + COALESCE(g, 0) * COALESCE(g, 0) AS n
      FROM {out}_w s FULL OUTER JOIN {out}_g d ON s.idx = d.idx)"""


def _train_sql(batch: str, held: str = "0") -> str:
    """Train rows in long form; ``t`` is a row's place in time and ``total`` their number."""
    return f"""{SLOTS}, rows AS (SELECT ID, CAST(click AS DOUBLE) AS y, row_number() OVER (ORDER BY datetime, ID) - 1 AS t,
      count(*) OVER () AS total, [CAST(0 AS BIGINT)] || {SLOT_LIST} AS x FROM slots WHERE split = 'train'),
    long AS MATERIALIZED (SELECT ID, y, {batch} AS batch, {held} AS held, unnest(x) AS idx FROM rows)"""


def _batch_sql(batches: int) -> str:
    return f"CAST(t // ((total + {batches - 1}) // {batches}) AS INT)"


def _rounds_sql(batches: int, epochs: int = 1) -> str:
    """The chain of states ``s1``, ``s2``, … over all batches and epochs."""
    order = [b for _ in range(epochs) for b in range(batches)]
    return ", ".join(_round_sql(f"batch = {b}", f"s{i}" if i else None, f"s{i + 1}") for i, b in enumerate(order))


@query(
    "ftrl_round",
    f"""WITH {_train_sql(f"CASE WHEN {unit_sql("ID || '_2017'")} < 0.5 THEN 0 ELSE 1 END")}, {_rounds_sql(2)}
    SELECT idx, round(z, 4) AS z, round(n, 4) AS n FROM s2""",
)
def ftrl_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after two rounds, one on each half of the train rows."""
    rows = materialize(ftrl_rows(spark, sf_dir).drop("datetime"), "rows")
    first = split.place() < 0.5
    p = ftrl.Ftrl()
    state, _ = ftrl.advance(ftrl.empty_state(spark), rows.where(first), p)
    state, _ = ftrl.advance(state, rows.where(~first), p)
    return rounded(state, "z", "n", digits=4)


FIT_EPOCHS, FIT_BATCHES = 2, 3


def _fit_sql() -> str:
    def epoch_loss(e: int) -> str:
        parts = [f"SELECT loss FROM s{e * FIT_BATCHES + b + 1}_l" for b in range(FIT_BATCHES)]
        return f"(SELECT avg(loss) FROM ({' UNION ALL '.join(parts)}))"

    first, second = f"s{FIT_BATCHES}", f"s{2 * FIT_BATCHES}"
    return f"""WITH {_train_sql(_batch_sql(FIT_BATCHES))}, {_rounds_sql(FIT_BATCHES, FIT_EPOCHS)},
    losses AS MATERIALIZED (SELECT {epoch_loss(0)} AS first_loss, {epoch_loss(1)} AS second_loss),
    best AS MATERIALIZED (SELECT idx, z, n FROM {first}, losses WHERE first_loss <= second_loss
      UNION ALL SELECT idx, z, n FROM {second}, losses WHERE second_loss < first_loss),
    weights AS (SELECT idx, CASE WHEN z = 0 THEN 0 ELSE -z / ((0.1 + sqrt(n)) / 0.1) END AS w FROM best),
    test AS (SELECT ID, unnest([CAST(0 AS BIGINT)] || {SLOT_LIST}) AS idx FROM slots WHERE split = 'test')
    SELECT ID, round(1 / (1 + exp(-greatest(least(sum(COALESCE(w, 0)), 35.0), -35.0))), 6) AS click
    FROM test LEFT JOIN weights USING (idx) GROUP BY ID"""


@query("ftrl_fit", _fit_sql())
def ftrl_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores of the state with the best training loss over the epochs."""
    model = ftrl.fit(ftrl_rows(spark, sf_dir), epochs=FIT_EPOCHS, batches=FIT_BATCHES)
    test = encode.hash_features(hashable(spark, sf_dir).where("split = 'test'"), HASHED).select("ID", "x")
    scored = ftrl.score(test, model.best_state, ftrl.Ftrl()).select("ID", F.col("p").alias("click"))
    return rounded(scored, "click")


@query("ftrl_roundtrip", f"SELECT ID, click, click AS click_loaded FROM ({_fit_sql()})")
def ftrl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores of the FTRL estimator's model, and of the model saved and read again."""
    rows = hashable(spark, sf_dir)
    estimator = FtrlEstimator(HASHED, epochs=FIT_EPOCHS, batches=FIT_BATCHES)
    path = new_path(spark, "ftrl")
    model = estimator.fit(rows.where("split = 'train'"))
    model.write().save(path)
    both = model.transform(rows.where("split = 'test'").drop("click")).withColumnRenamed("p", "click")
    both = FtrlModel.load(path).transform(both).select("ID", "click", F.col("p").alias("click_loaded"))
    return rounded(both, "click", "click_loaded")


PROGRESS_BATCHES = 5


def progress_sql(held: str, columns: str) -> str:
    """Losses of every batch before it is learnt; ``l`` has ``batch``, ``held`` and ``loss``."""
    parts = " UNION ALL ".join(f"SELECT {b} AS batch, held, loss FROM s{b + 1}_l" for b in range(PROGRESS_BATCHES))
    return f"""WITH {_train_sql(_batch_sql(PROGRESS_BATCHES), held)}, {_rounds_sql(PROGRESS_BATCHES)}, l AS ({parts})
    SELECT {columns} FROM l GROUP BY batch"""


@query(
    "progressive_loss",
    progress_sql(
        f"CASE WHEN {unit_sql("ID || '_holdout'")} < 0.1 THEN 1 ELSE 0 END",
        """0 AS epoch, batch, CAST(count(*) FILTER (WHERE held = 0) AS BIGINT) AS rows,
        round(avg(loss) FILTER (WHERE held = 0), 6) AS loss, CAST(count(*) FILTER (WHERE held = 1) AS BIGINT) AS held_rows,
        round(avg(loss) FILTER (WHERE held = 1), 6) AS held_loss""",
    ),
)
def progressive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each batch scored before it is learnt; a tenth of the rows is held out."""
    rows = ftrl_rows(spark, sf_dir)
    held = rows.withColumn("holdout", (split.place(seed="holdout") < 0.1).cast("int"))
    log = ftrl.log_frame(spark, ftrl.fit(held, epochs=1, batches=PROGRESS_BATCHES).log)
    return rounded(log, "loss", "held_loss")


@query(
    "numeric_class_nb",
    f"""WITH d AS (SELECT d.doc_id, d.n_chars, l.toxic, l.quality AS k, {unit_sql("d.doc_id || '_valid42'")} < 0.25 AS held
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    m AS (SELECT k, count(*) AS n, sum(CASE WHEN n_chars > 0 THEN 1 ELSE 0 END) AS on_chars,
      sum(CASE WHEN toxic > 0 THEN 1 ELSE 0 END) AS on_toxic FROM d WHERE NOT held GROUP BY k),
    s AS (SELECT k, ln(n / CAST((SELECT sum(n) FROM m) AS DOUBLE)) AS prior,
      (on_chars + 1) / CAST(n + 2 AS DOUBLE) AS chars, (on_toxic + 1) / CAST(n + 2 AS DOUBLE) AS toxic FROM m),
    j AS (SELECT d.doc_id, s.k, s.prior + ln(CASE WHEN d.n_chars > 0 THEN s.chars ELSE 1 - s.chars END)
      + ln(CASE WHEN d.toxic > 0 THEN s.toxic ELSE 1 - s.toxic END) AS l FROM d, s WHERE d.held),
    w AS (SELECT doc_id, max(l) FILTER (WHERE k = 0) AS l0, max(l) FILTER (WHERE k = 1) AS l1 FROM j GROUP BY doc_id)
    SELECT doc_id, round(1 / (1 + exp(l0 - l1)), 6) AS probability, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS prediction FROM w""",
)
def numeric_class_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of doubles with a ``class`` column, split and classified by naive Bayes."""
    docs = samples.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = samples.table(spark, sf_dir, "labels").withColumnRenamed("quality", "class")
    names = ["doc_id", "n_chars", "toxic", "class"]
    doubles = docs.join(labels, "doc_id").select(*[F.col(c).cast("double") for c in names])
    rows = readers.read_numeric(spark, writers.write_csv(doubles, new_path(spark, "numeric")), names)
    fit, held = split.train_valid_split(rows.withColumn("doc_id", F.col("doc_id").cast("bigint")), 0.25, "doc_id", 42)
    model = naive_bayes.fit_bernoulli_nb(fit, ["n_chars", "toxic"], label="class")
    return rounded(model.transform(held).select("doc_id", "probability", "prediction"), "probability")
