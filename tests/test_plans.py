"""Plans stay what they should be on large tables."""

from __future__ import annotations

import re

from conftest import SMALL
from oracle import plan
from pyspark.sql import functions as F

from clickloom import session
from clickloom.operators import counts, encode, metrics, prep
from clickloom.operators.lookup import JoinLimits
from clickloom.plans.catalog import ORACLE, QUERIES
from clickloom.sources import samples


def read_columns(df, marker):
    """Columns read from the scans whose schema mentions ``marker``."""
    found = set()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)):
        names = {part.split(":")[0] for part in schema.split(",")}
        if marker in names:
            found |= names
    return found


def test_scans_read_only_what_is_used(spark):
    got = read_columns(QUERIES["pair_count"](spark, SMALL), "event_id")
    assert got == {"event_id", "user_id", "props"}


def test_filters_reach_the_scan(spark):
    pushed = plan(samples.table(spark, SMALL, "events").where("value > 20").select("user_id"))
    assert "GreaterThan(value,20.0)" in pushed


def test_row_key_features_need_no_shuffle_when_unique(imps):
    names = ["site_ad_count", "device_id_count", "thour_id_count"]
    assert "Exchange" not in plan(counts.add_pair_counts(prep.prepare(imps), names, unique_key=True))
    declared = counts.add_pair_counts(prep.prepare(imps), counts.FEATURE_SETS[19], null_keys="keep", unique_key=True)
    found = counts.add_pair_counts(prep.prepare(imps), counts.FEATURE_SETS[19], null_keys="keep")
    assert declared.exceptAll(found).count() == found.exceptAll(declared).count() == 0


def test_row_key_features_share_one_shuffle(imps):
    twice = prep.prepare(imps.unionByName(imps))
    names = [f for f, p in counts.PAIRS.items() if "ID" in p]
    out = counts.add_pair_counts(twice, names)
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert out.select(F.min("site_ad_count"), F.max("tminute_id_count")).first() == (2, 2)


def test_small_pair_tables_do_not_shuffle_the_rows(imps):
    text = plan(counts.add_pair_counts(prep.prepare(imps), counts.FEATURE_SETS[3]))
    assert "Exchange hashpartitioning" not in text
    assert text.count("BroadcastHashJoin") >= 3


def test_large_pair_tables_are_not_broadcast_whole(imps):
    """Past the limit only the hot pairs are broadcast; the rest is joined with a salt."""
    spark = imps.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        limits = JoinLimits(broadcast_bytes=-1, hot_rows=5, hot_share=0.0)
        text = plan(counts.add_pair_counts(prep.prepare(imps), ["site_offer_count"], limits=limits))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("BroadcastHashJoin") == 1
    assert "_salt" in text and "SortMergeJoin" in text


def test_scores_are_collapsed_before_they_are_ordered(imps):
    """The window sees one row per distinct score, read from a table."""
    df = samples.with_scores(imps)
    text = plan(metrics.score_ladder(df, "score_a", "click"))
    assert "FileScan parquet" in text and "score_a" not in text


def test_weight_slots_are_hashed_once(imps):
    """No size test on the slot array below, which would compute all hashes again."""
    df = encode.hash_interactions(prep.cast_categorical(prep.prepare(imps), ["siteid"]), ["siteid", "devid"])
    assert "size(" not in plan(df.select("ID", F.explode_outer("x")))


def test_work_dir_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.new_path(spark, "x")
    assert shared is None or folder.startswith(shared.rstrip("/"))
    assert folder != session.new_path(spark, "x")


def test_every_query_name_is_plain():
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d+_", n)]
    assert set(ORACLE) <= set(QUERIES)


def test_work_tables_are_removed(spark):
    from pathlib import Path

    from clickloom import session

    df = session.materialize(spark.range(3), "gone")
    path = session._made[spark.sparkContext.applicationId][-1]
    assert df.count() == 3 and Path(path).exists()
    kept, session._made[spark.sparkContext.applicationId] = session._made[spark.sparkContext.applicationId][:-1], [path]
    session.remove_work(spark)
    assert not Path(path).exists()
    session._made[spark.sparkContext.applicationId] = kept
