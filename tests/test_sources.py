from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from clickloom.operators import ftrl, profile
from clickloom.sources import readers, samples, writers
from clickloom.session import materialize, new_path

# Published values: the logs of a ten-round run.
META = ["name\texperiment", "iterCount\t10", "learnErrorLog\tlearn_error.tsv", "loss\tAUC\tmax"]
LEARN = ["iter\tAUC", "0\t0.9796877145", "1\t0.9828479557"]
TIMES = ["0\t1161668\t129074", "1\t909711\t227427"]


def text(spark, lines):
    path = new_path(spark, "text")
    spark.createDataFrame([(s,) for s in lines], "value string").coalesce(1).write.text(path)
    return path


def test_run_logs(spark):
    meta = readers.pivot_meta(readers.read_run_meta(spark, text(spark, META)), ["name", "iterCount", "loss"])
    assert tuple(meta.first()) == ("experiment", "10", "AUC")
    log = readers.read_metric_log(spark, text(spark, LEARN))
    assert [tuple(r) for r in log.orderBy("iter").collect()] == [(0, 0.9796877145), (1, 0.9828479557)]
    times = readers.read_time_log(spark, text(spark, TIMES))
    assert [tuple(r) for r in times.orderBy("iter").collect()] == [(0, 1161668, 129074), (1, 909711, 227427)]


def test_csv_round_trip_keeps_types_and_nulls(spark, imps):
    back = readers.read_impressions(spark, writers.write_csv(imps, new_path(spark, "csv")))
    assert back.schema.simpleString() == imps.schema.simpleString()
    assert back.exceptAll(imps).count() == 0 == imps.exceptAll(back).count()


def test_seconds_without_fraction_are_read(spark):
    lines = ["ID,datetime,siteid,offerid,category,merchant,countrycode,browserid,devid,click,split",
             "a,2017-01-14 09:42:09,,1,2,3,c,,,0,train"]
    row = readers.read_impressions(spark, text(spark, lines)).first()
    assert row.datetime == datetime.datetime(2017, 1, 14, 9, 42, 9)
    assert row.siteid is None and row.browserid is None


def test_train_and_test_files_become_one_table(spark, imps):
    train = writers.write_csv(imps.where("split = 'train'").drop("split"), new_path(spark, "train"))
    test = writers.write_csv(imps.where("split = 'test'").drop("split", "click"), new_path(spark, "test"))
    both = readers.read_train_test(spark, train, test)
    assert both.count() == imps.count()
    assert both.where("split = 'test' AND click IS NOT NULL").count() == 0


def test_numeric_table(spark):
    rows = readers.read_numeric(spark, text(spark, ["a;class", "1;0", "2.5;1"]), ["a", "class"], sep=";")
    assert [tuple(r) for r in rows.collect()] == [(1.0, 0.0), (2.5, 1.0)]


def test_row_ids_follow_the_order(spark):
    df = spark.createDataFrame([("b", 0.2), ("a", 0.9), ("c", 0.4)], "k string, score double")
    got = sorted(tuple(r) for r in writers.row_id_frame(df, "score", ["k"]).collect())
    assert got == [(0, 0.9), (1, 0.2), (2, 0.4)]


def test_feature_map_skips_empty_columns(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b int, c string")
    got = sorted(tuple(r) for r in writers.feature_map(df, ["a", "b", "c"]).collect())
    assert got == [(0, "a", "q"), (2, "c", "q")]


def test_state_and_weights_round_trip(spark):
    state = spark.createDataFrame([(1, 0.5, 2.0)], ftrl.STATE_SCHEMA)
    assert ftrl.load_state(spark, ftrl.save_state(state, new_path(spark, "state"))).collect() == state.collect()
    weights = spark.createDataFrame([(1, 0.5, [1.0, 2.0])], "idx int, w double, v array<double>")
    path = writers.write_weights(weights, new_path(spark, "weights"))
    assert readers.read_weights(spark, path).collect() == weights.collect()


def test_running_mean_loss(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "t int, l double")
    got = sorted(tuple(r) for r in profile.running_mean_loss(df, F.col("l"), ["t"], 3).collect())
    assert got == [(0, 0.0), (3, 1.0), (6, 2.5)]


def test_shape_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, None), ("b", 1, None)], "s string, x int, y int")
    assert {tuple(r) for r in profile.shape(df, "s").collect()} == {("a", 2, 2), ("b", 1, 2)}
    fractions = {r["column"]: r.null_fraction for r in profile.null_fraction(df).collect()}
    assert fractions["s"] == 0 and fractions["y"] == 1 and abs(fractions["x"] - 1 / 3) < 1e-12


def test_materialized_table_is_the_frame(spark, imps):
    back = materialize(imps, "copy", ("split",))
    assert back.select(*imps.columns).exceptAll(imps).count() == 0


def test_large_tables_are_not_dealt_out(spark, imps):
    many = imps.repartition(32, "ID")
    assert samples.spread(many, "ID") is many


def test_malformed_sparse_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "rows.txt").write_text("1 0:0.5 3:2\n\nx 1:1\n0 a:1\n0 4\n0 4:y\n0\n")
    good = readers.read_sparse_text(spark, str(tmp_path)).collect()
    assert sorted((r.y, len(r.features)) for r in good) == [(0.0, 0), (1.0, 2)]
    bad = readers.read_malformed_sparse_text(spark, str(tmp_path)).collect()
    assert sorted(r.line for r in bad) == ["0 4", "0 4:y", "0 a:1", "x 1:1"]
