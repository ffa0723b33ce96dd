from __future__ import annotations

from math import exp, log, sqrt

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clickloom.operators import encode, ftrl, naive_bayes, prep, sparse
from clickloom.operators.lookup import JoinLimits
from clickloom.plans.linear import FACTORS, field_tables
from clickloom.session import folders, new_path
from clickloom.sources import readers, samples, writers
from clickloom.streaming import ftrl_stream

SMALL = "/root/testdata/sf0.001"


def test_fm_forms_agree(imps):
    """The linear-time sum over indices equals the dot products over fields."""
    df = prep.prepare(imps)
    tables = field_tables(df)
    fields = sparse.fm_score_fields(df, tables, "ID")
    parts = []
    for i, (c, t) in enumerate(tables.items()):
        parts.append(t.select(F.concat(F.lit(f"{i}:"), F.col(c).cast("string")).alias("idx"), "w", "v"))
    weights = parts[0]
    for p in parts[1:]:
        weights = weights.unionByName(p)
    entries = [
        F.struct(F.concat(F.lit(f"{i}:"), F.col(c).cast("string")).alias("idx"), F.lit(1.0).alias("value"))
        for i, c in enumerate(tables)
    ]
    rows = df.select("ID", F.array(*entries).alias("features"))
    linear = sparse.fm_score(rows, weights, "ID", FACTORS).withColumnRenamed("score", "other")
    gap = fields.join(linear, "ID").agg(F.max(F.abs(F.col("score") - F.col("other"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == df.count()


def test_scores_survive_forced_shuffle_and_gaps(spark):
    rows = samples.sparse_rows(spark, SMALL)
    weights = samples.fm_weights(sparse.to_long(rows, ["vec_id"]), FACTORS).where("idx % 5 != 0")
    forced = JoinLimits(-1, 10, 0.0, 4)
    for score in (
        lambda limits: sparse.linear_score(rows, weights, "vec_id", 0.5, limits),
        lambda limits: sparse.fm_score(rows, weights, "vec_id", FACTORS, 0.5, limits),
    ):
        a, b = score(sparse.DEFAULT_LIMITS), score(forced).withColumnRenamed("score", "other")
        got = a.join(b, "vec_id").agg(F.max(F.abs(F.col("score") - F.col("other"))), F.count("*")).first()
        assert got[0] < 1e-9 and got[1] == rows.count()


def test_row_without_entries_scores_the_bias(spark):
    rows = spark.sql("SELECT 7 vec_id, cast(array() AS array<struct<idx:int,value:double>>) features")
    weights = spark.createDataFrame([(0, 1.0, [1.0])], "idx int, w double, v array<double>")
    assert sparse.linear_score(rows, weights, "vec_id", 0.25).first().score == 0.25
    assert sparse.fm_score(rows, weights, "vec_id", 1, 0.25).first().score == 0.25


def test_sparse_text_round_trip(spark):
    path = new_path(spark, "lines")
    lines = ["1 0:0.5 3:1.5", "0 7:2", " 0 ", "1"]
    spark.createDataFrame([(s,) for s in lines], "value string").coalesce(1).write.text(path)
    got = [(r.y, [tuple(f) for f in r.features]) for r in readers.read_sparse_text(spark, path).collect()]
    assert got == [(1.0, [(0, 0.5), (3, 1.5)]), (0.0, [(7, 2.0)]), (0.0, []), (1.0, [])]
    back = new_path(spark, "lines")
    writers.sparse_lines(readers.read_sparse_text(spark, path)).coalesce(1).write.text(back)
    again = readers.read_sparse_text(spark, back)
    assert [(r.y, [tuple(f) for f in r.features]) for r in again.collect()] == got


def test_naive_bayes_conditionals_equal_sparks(imps):
    names = ["tweekday", "thour", "tminute"]
    df = prep.prepare(imps).withColumns({c: (F.col(c) > 5).cast("int") for c in names})
    mine = naive_bayes.fit_bernoulli_nb(df, names)
    vector = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    theirs = NaiveBayes(modelType="bernoulli", labelCol="click", smoothing=1.0).fit(vector)
    for k in (0, 1):
        got = [mine.log_on[k][c] for c in names]
        assert got == pytest.approx(list(theirs.theta.toArray()[k]), abs=1e-9)
    n = df.count()
    assert mine.prior[1] == pytest.approx(log(df.where("click = 1").count() / n))


def test_naive_bayes_needs_both_classes(imps):
    with pytest.raises(ValueError):
        naive_bayes.fit_bernoulli_nb(prep.prepare(imps).where("click = 1"), ["thour"])


def sequential(rows, p, l1=0.0):
    """One row at a time, the rule the mini-batches generalise."""
    z, n = {}, {}
    for x, y in rows:
        w = {}
        for i in x:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            s = -1.0 if zi < 0 else 1.0
            w[i] = 0.0 if s * zi <= p.l1 else (s * p.l1 - zi) / ((p.beta + sqrt(ni)) / p.alpha + p.l2)
        prob = 1 / (1 + exp(-max(min(sum(w[i] for i in x), 35.0), -35.0)))
        g = prob - y
        for i in x:
            sigma = (sqrt(n.get(i, 0.0) + g * g) - sqrt(n.get(i, 0.0))) / p.alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return z, n


@pytest.mark.parametrize("p", [ftrl.Ftrl(), ftrl.Ftrl(l1=0.2, l2=0.5, beta=1.0)])
def test_batches_of_one_row_are_the_sequential_rule(spark, p):
    rows = [([0, 3, 5], 1.0), ([0, 3, 6], 0.0), ([0, 5, 6], 1.0), ([0, 3, 5], 0.0)]
    state = ftrl.empty_state(spark)
    for i, (x, y) in enumerate(rows):
        one = spark.createDataFrame([(str(i), y, x)], "ID string, y double, x array<bigint>")
        state, _ = ftrl.advance(state, one, p)
    z, n = sequential(rows, p)
    got = {r.idx: (r.z, r.n) for r in state.collect()}
    assert set(got) == set(z)
    for i in z:
        assert got[i] == (pytest.approx(z[i]), pytest.approx(n[i]))


def test_l1_makes_weights_vanish(spark):
    df = spark.createDataFrame([(0.1, 1.0), (-0.1, 1.0), (-0.5, 1.0), (0.0, 0.0)], "z double, n double")
    w = [r[0] for r in df.select(ftrl.lazy_weight(F.col("z"), F.col("n"), ftrl.Ftrl(l1=0.2))).collect()]
    assert w[:2] == [0.0, 0.0] and w[3] == 0.0
    assert w[2] == pytest.approx(0.3 / ((0.1 + 1.0) / 0.1))


def test_copies_of_a_row_stay_whole(spark):
    rows = spark.createDataFrame([("a", 1.0, [0, 4])] * 5 + [("b", 0.0, [0, 9])], "ID string, y double, x array<bigint>")
    state = spark.createDataFrame([(0, -1.0, 1.0), (4, 2.0, 1.0)], ftrl.STATE_SCHEMA)
    got = sorted((r.ID, round(r.p, 9)) for r in ftrl.score(rows, state, ftrl.Ftrl()).collect())
    assert len(got) == 6
    w0, w4 = 1.0 / 11, -2.0 / 11
    assert got[0] == ("a", round(1 / (1 + exp(-(w0 + w4))), 9))
    assert got[5] == ("b", round(1 / (1 + exp(-w0)), 9))
    _, sums = ftrl.advance(state, rows, ftrl.Ftrl())
    assert sums["rows"] == 6


def test_holdout_rows_are_measured_not_learnt(spark):
    rows = [("a", 1.0, [0, 4], 0), ("b", 0.0, [0, 9], 1)]
    df = spark.createDataFrame(rows, "ID string, y double, x array<bigint>, holdout int")
    state, sums = ftrl.advance(ftrl.empty_state(spark), df, ftrl.Ftrl())
    assert (sums["rows"], sums["held_rows"]) == (1, 1)
    assert sums["held_loss"] == pytest.approx(log(2))
    learnt = {r.idx: r.n for r in state.collect()}
    assert learnt[9] == 0.0 and learnt[4] == pytest.approx(0.25)


def learnable_rows(learnable):
    df = prep.prepare(learnable)
    columns = ["category", "devid", "countrycode"]
    return encode.hash_interactions(df, columns).select("ID", "datetime", F.col("click").cast("double").alias("y"), "x")


def test_fit_learns(learnable):
    rows = learnable_rows(learnable)
    model = ftrl.fit(rows, epochs=2, batches=5)
    scored = ftrl.score(rows.drop("datetime"), model.best_state, ftrl.Ftrl())
    from clickloom.operators import metrics

    assert metrics.scalar(metrics.roc_auc(scored, "p", "y")) > 0.75
    assert model.log[-1]["loss"] / model.log[-1]["rows"] < model.log[0]["loss"] / model.log[0]["rows"]


def test_stream_equals_batches(spark, learnable):
    """The stream's state is that of the same batches applied in the same order."""
    rows = learnable_rows(learnable).drop("datetime")
    source, folder = new_path(spark, "source"), new_path(spark, "stream")
    parts = [rows.where(F.pmod(F.xxhash64("ID"), F.lit(2)) == k) for k in (0, 1)]
    state = ftrl.empty_state(spark)
    for part in parts:
        # A new file for each run of the stream, which resumes from its checkpoint.
        part.coalesce(1).write.mode("append").parquet(source)
        ftrl_stream.start(ftrl_stream.stream_rows(spark, source, rows.schema), folder).awaitTermination()
        state, _ = ftrl.advance(state, part, ftrl.Ftrl())
    streamed = ftrl_stream.read_state(spark, folder, 1).withColumnRenamed("z", "zs")
    gap = state.join(streamed, "idx", "full").agg(F.max(F.abs(F.col("z") - F.col("zs"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == state.count()
    assert [r.batch for r in ftrl_stream.progress(spark, folder, 2).orderBy("batch").collect()] == [0, 1]


def test_stream_keeps_two_states_and_survives_a_failed_batch(spark, learnable, monkeypatch):
    """Ten batches, of which one fails after its state is written: the same states as without, and a whole log."""
    rows = learnable_rows(learnable).drop("datetime")
    source, folder = new_path(spark, "source"), new_path(spark, "stream")
    state, learn = ftrl.empty_state(spark), ftrl_stream.train_batch
    failed = []

    def train(batch, version, where, p):
        learn(batch, version, where, p)
        if version == 4 and not failed:
            failed.append(version)
            raise RuntimeError("lost")

    monkeypatch.setattr(ftrl_stream, "train_batch", train)
    for k in range(10):
        part = rows.where(F.pmod(F.xxhash64("ID"), F.lit(10)) == k)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = ftrl_stream.stream_rows(spark, source, rows.schema)
        try:
            ftrl_stream.start(stream, folder).awaitTermination()
        except Exception:
            ftrl_stream.start(stream, folder).awaitTermination()
        state, _ = ftrl.advance(state, part, ftrl.Ftrl())
    assert failed and folders(spark, f"{folder}/state") == ["8", "9"]
    log = ftrl_stream.progress(spark, folder, 10).orderBy("batch").collect()
    assert [r.batch for r in log] == list(range(10)) and sum(r.rows for r in log) == rows.count()
    streamed = ftrl_stream.read_state(spark, folder, 9).withColumnRenamed("z", "zs")
    gap = state.join(streamed, "idx", "full").agg(F.max(F.abs(F.col("z") - F.col("zs"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == state.count()


def test_estimator_is_the_fit(learnable):
    from clickloom.models.online import FtrlEstimator

    df = prep.prepare(learnable)
    columns = ["category", "devid"]
    model = FtrlEstimator(columns, epochs=1, batches=3, interactions=True).fit(df)
    rows = encode.hash_interactions(df, columns).select("ID", "datetime", F.col("click").cast("double").alias("y"), "x")
    fitted = ftrl.fit(rows, epochs=1, batches=3)
    want = ftrl.score(rows.drop("datetime"), fitted.best_state, ftrl.Ftrl()).select("ID", F.col("p").alias("want"))
    both = model.transform(df).join(want, "ID")
    gap = both.agg(F.max(F.abs(F.col("p") - F.col("want"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == df.count()
    with pytest.raises(ValueError):
        FtrlEstimator(["click", "category"])


def test_ftrl_scores_without_moving_rows(spark):
    p = ftrl.Ftrl(alpha=0.5, beta=1.0, l1=0.1, size=1 << 14)
    state = spark.range(9000).select(F.col("id").alias("idx"), F.sin("id").alias("z"), F.lit(1.0).alias("n"))
    rows = spark.createDataFrame([("a", [0, 4096, 8192, 3]), ("b", []), ("c", [5, 5, 16000]), ("a", [0, 4096, 8192, 3])], "ID string, x array<bigint>")
    scored = ftrl.score(rows, state, p)
    plan = scored._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0].split("Subquery")[0]
    assert "Exchange" not in plan
    weights = state.select("idx", ftrl.lazy_weight(F.col("z"), F.col("n"), p).alias("w"))
    joined = ftrl._score_by_join(rows, weights)
    got, want = (sorted((r.ID, len(r.x), round(r.p, 9)) for r in d.collect()) for d in (scored, joined))
    assert got == want and ("b", 0, 0.5) in got and len(got) == 4


def test_ftrl_weights_are_no_column_of_the_rows(spark):
    state = spark.range(9000).select(F.col("id").alias("idx"), F.sin("id").alias("z"), F.lit(1.0).alias("n"))
    short = spark.createDataFrame([("a", [0, 4096, 3]), ("b", []), ("c", [500, 500, 8192])], "ID string, x array<bigint>")
    wide = short.unionByName(spark.createDataFrame([("d", [100] * 40)], short.schema))
    # A table in the plan, a broadcast one, and one joined to long rows.
    for rows, size in ((short, 1 << 14), (short, 1 << 20), (wide, 1 << 20)):
        p = ftrl.Ftrl(alpha=0.5, beta=1.0, size=size)
        scored = ftrl.score(rows, state, p)
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        # An array of weights in a row would cost as much as the whole table, row by row.
        assert "scalar-subquery" not in "".join(line for line in plan.splitlines() if "AS _" in line)
        weights = state.select("idx", ftrl.lazy_weight(F.col("z"), F.col("n"), p).alias("w"))
        got, want = ({r.ID: round(r.p, 9) for r in d.collect()} for d in (scored, ftrl._score_by_join(rows, weights)))
        assert got == want and got["b"] == 0.5 and len(got) == rows.count()
    joins = ftrl.score(short, state, ftrl.Ftrl())._jdf.queryExecution().executedPlan().toString()
    assert joins.count("BroadcastHashJoin") == 3 and "hashpartitioning" not in joins
