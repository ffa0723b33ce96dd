from __future__ import annotations

import hashlib

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from clickloom.operators import encode, ordinal, prep
from clickloom.operators.lookup import JoinLimits
from clickloom.plans.features import HASHED
from clickloom.sources import samples


def test_label_codes_equal_string_indexer(imps, monkeypatch):
    monkeypatch.setattr(ordinal, "BUCKET_ROWS", 8)
    df = prep.impute(imps).select("ID", F.col("ID").alias("key"), F.col("ID").alias("many"), "countrycode")
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"{c}_i", stringOrderType="alphabetAsc") for c in ("many", "countrycode")
    ]
    want = df
    for i in indexers:
        want = i.fit(df).transform(want)
    for limits in (encode.DEFAULT_LIMITS, JoinLimits(-1, 20, 0.0, 4)):
        got = encode.label_encode(df, ["many", "countrycode"], limits)
        joined = got.join(want.select("ID", "many_i", "countrycode_i"), "ID")
        assert joined.count() == df.count()
        assert joined.where("many != many_i OR countrycode != countrycode_i").count() == 0


def test_numbers_rank_as_numbers_and_nulls_stay(spark):
    df = spark.createDataFrame([(10, 2.5), (9, None), (100, -1.0), (9, 2.5)], "a int, b double")
    got = [tuple(r) for r in encode.label_encode(df, ["a", "b"]).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (0, None), (2, 0), (0, 1)], key=repr)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "k double, v double")
    scaled = encode.scale(df, encode.fit_scaler(df, ["k", "v"])).collect()
    assert [tuple(r) for r in scaled] == [(0.0, -1.0), (0.0, 1.0)]


def test_slots_are_md5(spark):
    df = spark.createDataFrame([("FR", None)], "country string, dev string")
    got = encode.hash_features(df, ["country", "dev"]).first().x
    want = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 2**20 for t in ("country_FR", "dev_")]
    assert got == [0, *want]


def test_interactions_add_every_pair(imps):
    df = prep.cast_categorical(prep.prepare(imps), ["siteid"])
    sizes = encode.hash_interactions(df, HASHED).select(F.size("x").alias("n")).distinct().collect()
    n = len(HASHED)
    assert [r.n for r in sizes] == [1 + n + n * (n - 1) // 2]
    assert "click" not in HASHED and "ID" not in HASHED


def test_row_normalize_modes(spark):
    df = spark.sql("SELECT 1 id, array(struct(0 idx, 3.0D value), struct(2 idx, 4.0D value)) features")
    by_square = encode.row_normalize(df).first().features
    by_norm = encode.row_normalize(df, mode="l2").first().features
    assert [f.value for f in by_square] == [pytest.approx(3 / 25), pytest.approx(4 / 25)]
    assert [f.value for f in by_norm] == [pytest.approx(0.6), pytest.approx(0.8)]
    zero = spark.sql("SELECT 1 id, array(struct(0 idx, 0.0D value)) features")
    assert encode.row_normalize(zero).first().features[0].value == 0.0


def test_dropout_share_and_repeatability(spark):
    rows = samples.sparse_rows(spark, "/root/testdata/sf0.001")
    kept = {n: encode.feature_dropout(rows.repartition(n), 0.25, "vec_id") for n in (2, 7)}
    counts = {n: {r.vec_id: [f.idx for f in r.features] for r in df.collect()} for n, df in kept.items()}
    assert counts[2] == counts[7]
    share = sum(map(len, counts[2].values())) / (64 * len(counts[2]))
    assert 0.73 < share < 0.77


def test_hierarchy_levels(spark):
    df = spark.createDataFrame([("US>CA>803",), ("US>CA",), ("US",), ("",)], "loc string")
    got = [tuple(r)[1:] for r in prep.split_hierarchy(df, "loc").collect()]
    assert got == [("US", "CA", "803"), ("US", "CA", ""), ("US", "", ""), ("", "", "")]


def test_unreadable_time_is_null(spark):
    df = spark.createDataFrame([("2017-01-14 09:42:09",), ("soon",)], "datetime string")
    got = [tuple(r)[1:] for r in prep.add_time_parts(prep.parse_datetime(df)).collect()]
    assert got == [(5, 9, 42), (None, None, None)]


def test_projection_helpers(imps):
    df = prep.prepare(imps)
    assert prep.feature_columns(df) == sorted(set(df.columns) - {"ID", "datetime", "click", "split"})
    assert prep.columns_except(df, ["ID", "datetime", "click"])[0] == "siteid"


def test_codes_of_every_type(spark):
    df = spark.sql("""SELECT * FROM VALUES (1.2BD, DATE'2024-01-02', true, 1.2D), (1.3BD, DATE'2024-01-01', false, 1.9D),
      (NULL, NULL, NULL, NULL) AS t(d, day, flag, x)""")
    got = sorted((tuple(r) for r in encode.label_encode(df, ["d", "day", "flag", "x"]).collect()), key=repr)
    assert got == [(0, 1, 1, 0), (1, 0, 0, 1), (None, None, None, None)]
    with pytest.raises(TypeError):
        encode.label_encode(df.selectExpr("array(d) AS a"), ["a"])


def test_nan_is_missing_and_fractions_stay(spark):
    from clickloom.operators import prep, profile

    df = spark.createDataFrame([(float("nan"),), (None,), (1.5,), (2.0,)], "x double")
    flagged = prep.missing_indicators(df, ["x"], {"x": -999.0}).collect()
    assert sorted((r.x, r.x_missing) for r in flagged) == [(-999.0, 1), (-999.0, 1), (1.5, 0), (2.0, 0)]
    assert profile.null_fraction(df).first()["null_fraction"] == 0.5
    assert {r.x for r in prep.cast_categorical(df.where("x > 1"), ["x"]).collect()} >= {"1.5", "2"}
