from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom.operators import counts, prep
from clickloom.operators.lookup import JoinLimits, lookup_join

FORCED = JoinLimits(broadcast_bytes=-1, hot_rows=2, hot_share=0.0, salts=3)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def repeats(spark):
    return spark.createDataFrame(
        [
            ("a", "train", 1.0, 7, "FR", "x"),
            ("a", "train", 1.0, 7, "FR", "x"),
            ("a", "train", 1.0, None, "DE", "y"),
            ("b", "train", 2.0, 7, None, "x"),
            ("b", "test", 1.0, 7, "FR", "x"),
            ("c", "train", 1.0, 7, "DE", "y"),
        ],
        "ID string, split string, siteid double, offerid int, countrycode string, devid string",
    )


def test_null_keys_drop(repeats):
    """A row with a null key goes, yet still counts where its own keys are present."""
    out = counts.add_pair_counts(repeats, ["site_offer_count", "site_ad_count", "country_ad_count"])
    got = rows(out, "ID", "split", "site_offer_count", "site_ad_count", "country_ad_count")
    assert got == [
        ("a", "train", 3, 3, 2),
        ("a", "train", 3, 3, 2),
        ("b", "test", 1, 1, 1),
        ("c", "train", 3, 1, 1),
    ]


def test_null_keys_keep(repeats):
    out = counts.add_pair_counts(repeats, ["site_offer_count", "country_offer_count"], null_keys="keep")
    assert out.count() == 6
    got = {(r.ID, r.split, r.offerid, r.countrycode): (r.site_offer_count, r.country_offer_count) for r in out.collect()}
    assert got[("a", "train", None, "DE")] == (1, 1)
    assert got[("b", "train", 7, None)] == (1, 1)


@pytest.mark.parametrize("null_keys", ["drop", "keep"])
def test_limits_do_not_change_results(repeats, null_keys):
    names = ["site_offer_count", "site_ad_count", "site_device_count", "device_id_count", "country_site_count"]
    plain = counts.add_pair_counts(repeats, names, null_keys=null_keys)
    forced = counts.add_pair_counts(repeats, names, null_keys=null_keys, limits=FORCED)
    assert rows(plain, *plain.columns) == rows(forced, *forced.columns)


def test_all_features_equal_windows(imps):
    df = prep.prepare(imps)
    names = counts.FEATURE_SETS[19]
    out = counts.add_pair_counts(df, names)
    over = {f: F.count("*").over(Window.partitionBy("split", *counts.PAIRS[f])).alias(f) for f in names}
    assert rows(out, "ID", *names) == rows(df.select("ID", *over.values()), "ID", *names)
    assert rows(counts.add_pair_counts(df, names, limits=FORCED), "ID", *names) == rows(out, "ID", *names)


def test_unknown_null_mode(repeats):
    with pytest.raises(ValueError):
        counts.add_pair_counts(repeats, ["site_offer_count"], null_keys="zero")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_lookup_with_a_hot_key(spark, how, null_safe):
    """A third of the rows share one key, some are null and some are unknown."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97)
    df = spark.range(3000).withColumn("k", key.cast("int"))
    keys = [(i, f"v{i}", 1.0 * i if i % 2 else None) for i in range(0, 90)] + [(None, "none", None)]
    table = spark.createDataFrame(keys, "k int, v string, w double")
    join = {"how": how, "null_safe": null_safe}
    plain = lookup_join(df, table, ["k"], **join)
    hot = lookup_join(df, table, ["k"], limits=JoinLimits(-1, 100, 0.0, 8), **join)
    weighted = lookup_join(
        df, table.join(df.groupBy("k").count(), "k"), ["k"], weight="count", limits=JoinLimits(-1, 100, 0.0, 8), **join
    ).drop("count")
    assert rows(hot, *plain.columns) == rows(plain, *plain.columns)
    if not null_safe:
        assert rows(weighted, *plain.columns) == rows(plain, *plain.columns)
    if how == "left":
        assert plain.count() == 3000


def test_hot_rows_are_spread(spark):
    """With forced limits the hot rows do not share one shuffle partition."""
    df = spark.range(4000).withColumn("k", F.when(F.col("id") < 3000, 0).otherwise(F.col("id")))
    table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = lookup_join(df, table, ["k"], limits=JoinLimits(-1, 100, 0.0, 64))
    # AQE would merge these small partitions again.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000
    assert max(sizes) < 2000


def test_rows_without_a_key_are_spread(spark):
    df = spark.range(4000).withColumn("k", F.when(F.col("id") >= 3000, F.col("id")))
    table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = lookup_join(df, table, ["k"], "left", limits=JoinLimits(-1, 10_000, 0.0, 64))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert out.where("v IS NULL").count() == 3000


def test_broadcasts_share_a_budget():
    from clickloom.operators.lookup import within_total

    limits = JoinLimits(broadcast_bytes=50, broadcast_total=100)
    assert within_total({"a": 40, "b": 10, "c": 45, "d": 30}, limits) == {"b": 10, "d": 30, "a": 40, "c": 51}
